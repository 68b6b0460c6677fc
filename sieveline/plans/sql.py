"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from sieveline import constants as C


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def split_identifier(x: str) -> str:
    return rf"list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"


def tokenize(x: str) -> str:
    parts = split_identifier("w")
    every = f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([lower(w)], {parts}) ELSE {parts} END))"
    return f"list_filter({every}, lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({listed([*C.C_KEYWORDS, *C.STOP_WORDS])}))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def query_text(x: str) -> str:
    own = words(x)
    return f"CASE WHEN len({own}) >= {C.MIN_QUERY_WORDS} AND len({tokenize(x)}) > 0 AND NOT contains(lower({x}), 'copyright') AND NOT contains(lower({x}), 'license') THEN array_to_string({own}[1:{C.MAX_QUERY_WORDS}], ' ') END"


def dense_text(name: str, file: str, text: str) -> str:
    return f"array_to_string({split_identifier(name)}, ' ') || ' (' || {file} || ')' || chr(10) || {text}"


def code_body(x: str) -> str:
    return f"CASE WHEN contains({x}, chr(10)) AND ends_with(split_part({x}, chr(10), 1), ')') THEN substr({x}, length(split_part({x}, chr(10), 1)) + 2) ELSE {x} END"


def code_tokens(x: str) -> str:
    return rf"regexp_extract_all({code_body(x)}, '[A-Za-z_][\p{{L}}\p{{N}}_]*|\p{{Nd}}+|[^\s]')"


def normalise_code(x: str) -> str:
    return f"array_to_string({code_tokens(x)}, ' ')"


def shingles(tokens: str, k: int) -> str:
    return f"CASE WHEN len({tokens}) >= {k} THEN list_distinct(list_transform(range(1, len({tokens}) - {k} + 2), lambda i: array_to_string(({tokens})[i:i + {k - 1}], ' '))) WHEN len({tokens}) > 0 THEN [array_to_string({tokens}, ' ')] ELSE [] END"


def comment_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{C.COMMENT_WORD}')"


def split_of(repo: str, file: str) -> str:
    return f"CASE WHEN ('0x' || substr(sha1({repo} || '/' || {file}), 1, 8))::BIGINT / 4294967295.0::DOUBLE < {C.VAL_FRACTION} THEN 'val' ELSE 'train' END"


def bm25(docs: str, queries: str, group: str | None = None) -> str:
    """CTEs that end in bm(query_id, ordinal, score); docs(ordinal, tokens), queries(query_id, tokens) are CTEs; within group where one is named."""
    g, on, by = (f"{group}, ", f"USING ({group})", f"GROUP BY {group}") if group else ("", "ON true", "")
    same = f"AND x.{group} = y.{group}" if group else ""
    pick = f"x.{group}, " if group else ""
    return f"""bm_len AS (SELECT {g}ordinal, len(tokens) AS dl, tokens FROM {docs}),
bm_corpus AS (SELECT {g}count(*) AS n, avg(dl) AS avgdl FROM bm_len {by}),
bm_post AS (SELECT {g}ordinal, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {g}ordinal, dl, unnest(tokens) AS term FROM bm_len) GROUP BY ALL),
bm_terms AS (SELECT {g}term, count(*) AS df FROM bm_post GROUP BY ALL),
bm_impact AS (SELECT {pick}x.ordinal, x.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {C.BM25_K1 + 1} / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * dl / avgdl)) AS part
  FROM bm_post x JOIN bm_terms y ON x.term = y.term {same} JOIN bm_corpus z {on.replace("USING (" + (group or "") + ")", f"ON x.{group} = z.{group}") if group else "ON true"}),
bm_query AS (SELECT DISTINCT {g}query_id, term FROM (SELECT {g}query_id, unnest(tokens) AS term FROM {queries})),
bm AS (SELECT {pick}y.query_id, x.ordinal, sum(part) AS score FROM bm_impact x JOIN bm_query y ON x.term = y.term {same} GROUP BY ALL)"""


def ranked(rows: str, decimals: int = 9) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {decimals}) DESC, ordinal) AS rank FROM {rows}"


def filled(scored: str, queries: str, docs: str, depth: int) -> str:
    """A full list of scores: documents without one have 0."""
    return f"SELECT q.query_id, d.ordinal, coalesce(s.score, 0.0) AS score FROM {queries} q CROSS JOIN (SELECT ordinal FROM {docs}) d LEFT JOIN {scored} s ON s.query_id = q.query_id AND s.ordinal = d.ordinal"


def max_jaccard(left: str, right: str, name: str) -> str:
    """CTE name(a, j); left(a, shingles) and right(b, shingles) are CTEs."""
    return f"""{name}_x AS (SELECT a, len(shingles) AS na, unnest(shingles) AS s FROM {left}),
{name}_y AS (SELECT b, len(shingles) AS nb, unnest(shingles) AS s FROM {right}),
{name}_p AS (SELECT a, b, count(*) AS i, any_value(na) AS na, any_value(nb) AS nb FROM {name}_x JOIN {name}_y USING (s) GROUP BY a, b),
{name} AS (SELECT l.a, coalesce(max(i / (na + nb - i)), 0.0) AS j FROM {left} l LEFT JOIN {name}_p p ON l.a = p.a GROUP BY l.a)"""
