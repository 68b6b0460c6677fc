"""DuckDB SQL of the queries that SQL can say on whole tables."""

from __future__ import annotations

from sieveline.llm.quality_rules import RULE_SQL, RULES

_SPACES = r"[^\x20\x09-\x0D]+"

#: Lower case of A-Z only.
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_SPACES}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
often AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
k AS (SELECT e.doc_id, n.n, e.g FROM e JOIN often USING (g) JOIN n USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS i FROM k x JOIN k y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
edges AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, edges.b FROM reach r JOIN edges ON edges.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n"""

QUALITY_RULES = rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
ls AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_SPACES}') GROUP BY ALL),
lines AS (SELECT doc_id, sum(c) - count(*) AS n_dup_lines, sum(c) AS n_lines FROM ls GROUP BY doc_id),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, g FROM t GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT t.doc_id, unnest([i, i + 1, i + 2]) AS p FROM t JOIN twice ON twice.doc_id = t.doc_id AND twice.g = t.g) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS wc, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN hit USING (doc_id)),
figures AS (SELECT * EXCLUDE (wc), coalesce(wc, 0)::BIGINT AS word_chars FROM f),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"sum(CASE WHEN {sql} THEN 1 ELSE 0 END) AS {rule}" for rule, sql in RULE_SQL.items())} FROM figures WHERE source IS NOT NULL GROUP BY source),
long AS ({" UNION ALL ".join(f"SELECT source, n, '{r}' AS rule, {r} AS failed FROM hosts" for r in RULES)}),
prior AS (SELECT rule, avg(failed / n) AS m, avg((failed / n) * (failed / n)) - avg(failed / n) * avg(failed / n) AS v FROM long GROUP BY rule),
weights AS (SELECT rule, m, CASE WHEN v <= 1e-12 OR m * (1 - m) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, m * (1 - m) / greatest(v, 1e-12) - 1)) END AS k FROM prior),
bad AS (SELECT DISTINCT source FROM long JOIN weights USING (rule) WHERE (failed + m * k) / (n + k) >= 0.5),
j AS (SELECT *, ({RULE_SQL["short"]}) OR ({RULE_SQL["repeats"]}) AS base_failed, source IS NOT NULL AND source IN (SELECT source FROM bad) AS host_condemned FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_condemned AS kept, host_condemned FROM j"""

_CONTENT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_CONTENT}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_CONTENT}') AS w FROM benchmark),
bx AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bx),
dx AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dx.k, item_id FROM dx JOIN bx ON bx.k = dx.k AND bx.g = dx.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _crc_table() -> list[int]:
    """The usual reflected polynomial, four bits at a time."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32(x: str) -> str:
    """The unsigned crc32 of a text of ASCII characters; DuckDB has none."""
    table = f"[{', '.join(f'{v}::UBIGINT' for v in _crc_table())}]"

    def four_bits(y: str) -> str:
        return f"xor({table}[(({y}) & 15)::BIGINT + 1], ({y}) >> 4)"

    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: {four_bits(four_bits('xor(a, b)'))}), 4294967295::UBIGINT)::BIGINT"


def _framed(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _merkle(fanout: int) -> str:
    """Levels of the sources' trees (src >= 0) and of the one over them (src -1), then each row's path folded upwards."""
    # MATERIALIZED: the rows of a tie must get the same numbers wherever the table is read.
    return rf"""WITH RECURSIVE ids AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT doc_id, src, {_leaf("text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {_leaf(_LOWER.format(x="text"))} END AS altered FROM (SELECT *, {crc32("doc_id::VARCHAR")} AS crc FROM documents) t JOIN ids ON t.source IS NOT DISTINCT FROM ids.name),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (SELECT 0 AS k, src, pos, leaf AS digest, count(*) OVER (PARTITION BY src) AS n FROM leaves
  UNION ALL SELECT k + 1, src, pos // {fanout}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {fanout - 1}) // {fanout} FROM lv WHERE n > 1 GROUP BY k, src, pos // {fanout}),
subroots AS MATERIALIZED (SELECT src, k, digest FROM lv WHERE n = 1),
tv AS (SELECT 0 AS k, src AS pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT k + 1, pos // {fanout}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {fanout - 1}) // {fanout} FROM tv WHERE n > 1 GROUP BY k, pos // {fanout}),
nodes AS MATERIALIZED (SELECT k, src, pos, digest, n FROM lv UNION ALL SELECT k, -1, pos, digest, n FROM tv),
around AS MATERIALIZED (SELECT k, src, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY k, src, pos // {fanout} ORDER BY pos)),
steps AS MATERIALIZED (SELECT src, min(k) FILTER (WHERE n = 1) AS height FROM nodes GROUP BY src),
climb AS (SELECT doc_id, leaf, src, pos AS leaf_pos, 0 AS step, coalesce(altered, leaf) AS acc, '' AS proof FROM leaves
  UNION ALL SELECT c.doc_id, c.leaf, c.src, c.leaf_pos, c.step + 1, sha256(a.before || c.acc || a.after), c.proof || a.before || a.after FROM climb c JOIN steps s ON s.src = c.src JOIN around a
    ON a.src = CASE WHEN c.step < s.height THEN c.src ELSE -1 END AND a.k = CASE WHEN c.step < s.height THEN c.step ELSE c.step - s.height END
    AND a.pos = CASE WHEN c.step < s.height THEN c.leaf_pos // ({fanout} ** c.step)::BIGINT ELSE c.src // ({fanout} ** (c.step - s.height))::BIGINT END)
SELECT doc_id, leaf, r.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.digest AS verified
FROM climb JOIN subroots r ON r.src = climb.src JOIN steps s ON s.src = climb.src CROSS JOIN (SELECT digest, k FROM tv WHERE n = 1) t WHERE climb.step = s.height + t.k"""


MERKLE = _merkle(16)


def _quantiles(cuts: int, parts: int, least: int, batches: int, allowed: int) -> str:
    """allowed: in thousandths of the rows."""
    batch = lambda key: f"(coalesce({crc32(key + '::VARCHAR')}, 0) % {batches})::INT"
    finite = lambda x: f"{x} IS NOT NULL AND isfinite({x})"
    k = "stream, grp, batch"
    hits = lambda rows: f"SELECT {k}, n, points, x AS answer, unnest(range(greatest(1, least({parts}, coalesce(lag(reach) OVER w, 0) + 1)), least({parts}, reach + 1))) AS i FROM (SELECT *, ((lo + hi) // 2) * {parts} // n AS reach, count(*) OVER (PARTITION BY {k}) AS points FROM {rows} WHERE n >= {least}) WINDOW w AS (PARTITION BY {k} ORDER BY x)"
    return f"""WITH c AS (SELECT click_id, client_id, value FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, client_id NULLS FIRST, value NULLS FIRST) AS nth FROM clicks) WHERE nth = 1),
r AS (SELECT 'value' AS stream, client_id::VARCHAR AS grp, {batch('click_id')} AS batch, value AS money FROM c WHERE client_id IS NOT NULL AND {finite('value')}
  UNION ALL SELECT 'price', brand, {batch('vendor_id')}, price FROM sale_lines JOIN items USING (item_id) WHERE brand IS NOT NULL AND {finite('price')}),
h AS MATERIALIZED (SELECT {k}, (floor(100 * money + 0.5) + 1000 * batch)::BIGINT AS x, count(*) AS c FROM r GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER (PARTITION BY {k} ORDER BY x)::BIGINT AS upto, sum(c) OVER (PARTITION BY {k})::BIGINT AS n, row_number() OVER (PARTITION BY {k} ORDER BY x) AS d, count(*) OVER (PARTITION BY {k}) AS dd FROM h),
pts AS MATERIALIZED (SELECT {k}, x, n, upto - c AS below, upto FROM cum WHERE upto * least(n, {cuts}) // n > (upto - c) * least(n, {cuts}) // n OR d <= 2 OR d >= dd - 1),
step AS (SELECT *, upto - coalesce(lag(upto) OVER w, 0) AS c0, upto - below AS d0, coalesce(lead(below) OVER w, upto) - upto AS d1 FROM pts WINDOW w AS (PARTITION BY {k} ORDER BY x)),
at_x AS (SELECT stream, grp, x, sum(c0)::BIGINT AS c0, sum(d0)::BIGINT AS d0, sum(d1)::BIGINT AS d1 FROM step GROUP BY ALL),
whole AS MATERIALIZED (SELECT stream, grp, -1 AS batch, x, (sum(c0) OVER w)::BIGINT AS lo, (sum(d0) OVER w + sum(d1) OVER w - d1)::BIGINT AS hi, sum(c0) OVER (PARTITION BY stream, grp)::BIGINT AS n FROM at_x WINDOW w AS (PARTITION BY stream, grp ORDER BY x)),
every AS (SELECT {k}, x, n, upto AS lo, upto AS hi FROM pts UNION ALL SELECT {k}, x, n, lo, hi FROM whole),
a AS MATERIALIZED ({hits('every')}),
full_h AS (SELECT {k}, x, c FROM h UNION ALL SELECT stream, grp, -1, x, sum(c)::BIGINT FROM h GROUP BY ALL),
ranks AS MATERIALIZED (SELECT {k}, x, (sum(c) OVER w)::BIGINT AS upto, (sum(c) OVER w)::BIGINT - c AS below FROM full_h WINDOW w AS (PARTITION BY {k} ORDER BY x)),
t AS (SELECT *, (i * n + {parts - 1}) // {parts} AS target FROM a),
f AS (SELECT {', '.join('t.' + c for c in ('stream', 'grp', 'batch', 'i', 'n', 'target', 'points', 'answer'))}, e.x AS exact_x, b.below AS n_below, b.upto AS n_upto
  FROM t JOIN ranks e ON e.stream = t.stream AND e.grp = t.grp AND e.batch = t.batch AND e.below < target AND e.upto >= target JOIN ranks b ON b.stream = t.stream AND b.grp = t.grp AND b.batch = t.batch AND b.x = answer)
SELECT stream, grp, batch, i::INT AS i, n, target, exact_x, points, answer, n_below, n_upto, greatest(0, n_below + 1 - target, target - n_upto) AS rank_error, 1000 * greatest(0, n_below + 1 - target, target - n_upto) <= {allowed} * n AS within FROM f"""


QUANTILES = _quantiles(40, 10, 20, 8, 50)
