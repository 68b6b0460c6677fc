"""Queries of the text functions, scans and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.functions import text as T
from sieveline.operators.numbering import numbered
from sieveline.plans import sql as S
from sieveline.plans.registering import query
from sieveline.plans.standins import UNITS, table, units
from sieveline.sources import c_units, registry


@query("split_identifier", f"WITH {UNITS}, w2 AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM d) SELECT word, array_to_string({S.split_identifier('word')}, ' ') AS parts FROM w2")
def split_identifier(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(T.split_identifier("word"), " ").alias("parts"))


@query("tokenize", f"WITH {UNITS} SELECT doc_id, array_to_string({S.tokenize('text')}, ' ') AS tokens FROM d")
def tokenize(spark, sf):
    return units(spark, sf).select(F.col("ordinal").alias("doc_id"), F.array_join(T.tokenize("text"), " ").alias("tokens"))


@query("lexical_text", f"WITH {UNITS} SELECT ordinal, file || ' ' || comment || chr(10) || body AS text FROM units WHERE comment <> '' UNION ALL SELECT ordinal, file || ' ' || body FROM units WHERE comment = ''")
def lexical_text(spark, sf):
    return units(spark, sf).select("ordinal", T.lexical_text("file", T.unit_text("comment_raw", "body")).alias("text"))


@query("dense_text", f"WITH {UNITS} SELECT ordinal, {S.dense_text('name', 'file', 'body')} AS text FROM units")
def dense_text(spark, sf):
    return units(spark, sf).select("ordinal", T.dense_text("name", "file", "body").alias("text"))


@query("query_text", f"WITH {UNITS} SELECT ordinal, {S.query_text('comment')} AS query FROM units")
def query_text(spark, sf):
    return units(spark, sf).select("ordinal", T.query_text("comment").alias("query"))


@query("code_body", f"WITH {UNITS}, x AS (SELECT ordinal, {S.dense_text('name', 'file', 'body')} AS code FROM units) SELECT ordinal, {S.code_body('code')} AS body FROM x")
def code_body(spark, sf):
    return units(spark, sf).select("ordinal", T.code_body(T.dense_text("name", "file", "body")).alias("body"))


@query("normalise_code", f"WITH {UNITS} SELECT ordinal, {S.normalise_code('text')} AS code FROM units")
def normalise_code(spark, sf):
    return units(spark, sf).select("ordinal", T.normalise_code("text").alias("code"))


@query("code_hash", f"WITH {UNITS} SELECT ordinal, sha1({S.normalise_code('text')}) AS hash FROM units")
def code_hash(spark, sf):
    return units(spark, sf).select("ordinal", T.code_hash("text").alias("hash"))


@query("code_shingles", f"WITH {UNITS}, x AS (SELECT ordinal, {S.code_tokens('text')} AS t FROM units) SELECT ordinal, unnest({S.shingles('t', 5)}) AS shingle FROM x")
def code_shingles(spark, sf):
    return units(spark, sf).select("ordinal", F.explode(T.code_shingles("text")).alias("shingle"))


@query("comment_shingles", f"WITH {UNITS}, x AS (SELECT ordinal, {S.comment_words('comment')} AS t FROM units) SELECT ordinal, unnest({S.shingles('t', 3)}) AS shingle FROM x")
def comment_shingles(spark, sf):
    return units(spark, sf).select("ordinal", F.explode(T.comment_shingles("comment")).alias("shingle"))


@query("hash_split", f"WITH {UNITS} SELECT ordinal, {S.split_of('repo', 'ordinal')} AS split FROM units")
def hash_split(spark, sf):
    return units(spark, sf).select("ordinal", T.split_of("repo", F.col("ordinal").cast("string")).alias("split"))


@query("norm_ws", f"SELECT page_id, {S.squeeze('html')} AS text FROM pages")
def norm_ws(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.squeeze("html").alias("text"))


_RAW = "'/* === ' || replace(text, chr(10), chr(10) || ' * // ') || ' ***' || chr(10) || ' * -----' || chr(10) || ' */'"


@query("clean_comment", rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split({_RAW}, chr(10)) AS x FROM documents)),
a AS (SELECT doc_id, i, replace(replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^//', ''), '/*', ' '), '*/', ' ') AS line FROM l),
b AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[\s/*!<-]*', ''), '\s+$', ''), '\*+$', ''), '^\s+|\s+$', '', 'g') AS line FROM a)
SELECT doc_id, {S.squeeze("coalesce(string_agg(line, ' ' ORDER BY i) FILTER (WHERE NOT regexp_full_match(line, '[\\s=*#~_+-]*')), '')")} AS comment FROM b GROUP BY doc_id""".replace("\\\\s", "\\s"))
def clean_comment(spark, sf):
    raw = F.concat(F.lit("/* === "), F.regexp_replace("text", "\n", "\n * // "), F.lit(" ***\n * -----\n */"))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.clean_comment(raw).alias("comment"))


@query("array_distinct_order", f"WITH {UNITS}, e AS (SELECT ordinal, x, min(i) AS i FROM (SELECT ordinal, unnest(w[2:]) AS x, generate_subscripts(w[2:], 1) AS i FROM units) GROUP BY ALL) SELECT u.ordinal, coalesce(string_agg(x, ' ' ORDER BY i), '') AS calls FROM units u LEFT JOIN e USING (ordinal) GROUP BY u.ordinal")
def array_distinct_order(spark, sf):
    return units(spark, sf).select("ordinal", F.array_join("calls", " ").alias("calls"))


@query("comment_runs", """WITH t AS (SELECT conv_id, turn, role, turn - lag(turn) OVER w > 2 OR lag(role) OVER w IS DISTINCT FROM role AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, (sum(CASE WHEN new OR new IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS run FROM t)
SELECT conv_id, run, any_value(role) AS role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY conv_id, run""")
def comment_runs(spark, sf):
    """Runs of neighbouring rows of a kind, as runs of comments above a definition: a new one begins after a gap or another kind."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    new = (F.col("turn") - F.lag("turn").over(order) > 2) | ~F.lag("role").over(order).eqNullSafe(F.col("role"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(new, F.lit(True)).alias("new"))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("long")).over(order))
    return rows.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("scan_order", """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '.c' AS file FROM pages),
k AS (SELECT *, list_transform(string_split(file, '/'), lambda x, i: {'d': CASE WHEN i < len(string_split(file, '/')) THEN 1 ELSE 0 END, 'n': x}) AS key FROM p)
SELECT page_id, file, row_number() OVER (ORDER BY key, page_id) AS nth FROM k""")
def scan_order(spark, sf):
    """All pages' paths numbered in the order of a walk."""
    files = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".c")).alias("file"))
    return numbered(files, [c_units.walk_key(), "page_id"]).select("page_id", "file", (F.col("nth") + 1).alias("nth"))


@query("scan_subdirs", """SELECT page_id, 'lib/' || regexp_replace(url, '^[a-z]+://', '') AS file FROM pages WHERE url LIKE '%/en/%'
UNION ALL SELECT page_id, 'src/' || regexp_replace(url, '^[a-z]+://', '') FROM pages WHERE url LIKE '%/de/%'""")
def scan_subdirs(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    parts = [pages.where(F.col("url").like(f"%/{lang}/%")).select("page_id", F.concat(F.lit(f"{sub}/"), "path").alias("file")) for sub, lang in (("lib", "en"), ("src", "de"))]
    return parts[0].unionByName(parts[1])


@query("unit_ids", f"WITH {UNITS} SELECT ordinal, CASE WHEN count(*) OVER (PARTITION BY repo, file, name) = 1 THEN file || '::' || name ELSE file || '::' || name || '@' || ordinal END AS id FROM units")
def unit_ids(spark, sf):
    own = units(spark, sf).select("repo", "file", "name", "ordinal", F.lit(0).alias("nth"), "start_line")
    return c_units.with_ids(own.withColumnRenamed("ordinal", "given")).select(F.col("given").alias("ordinal"), "id")


@query("prefix_lookup", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{C.QUERY_PREFIXES['BAAI/bge-base-en-v1.5']}' WHEN 1 THEN 'find: ' ELSE '' END || coalesce(text, '') AS query FROM documents")
def prefix_lookup(spark, sf):
    model = F.when(F.col("doc_id") % 3 == 0, "BAAI/bge-base-en-v1.5").otherwise("own/model")
    meta = F.when(F.col("doc_id") % 3 == 1, F.lit('{"query_prefix": "find: "}'))
    return table(spark, sf, "documents").select("doc_id", F.concat(T.query_prefix(model, meta), F.coalesce("text", F.lit(""))).alias("query"))


@query("rank_transforms", "SELECT l_orderkey, l_linenumber, round(1.0 / l_linenumber, 9) AS rr, CASE WHEN l_linenumber <= 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_1, CASE WHEN l_linenumber <= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_5 FROM lineitem")
def rank_transforms(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.reciprocal_rank("l_linenumber"), 9).alias("rr"), T.recall_at("l_linenumber", 1).alias("hit_1"), T.recall_at("l_linenumber", 5).alias("hit_5"))


@query("fingerprint", f"""WITH RECURSIVE {UNITS}, lv AS (SELECT 0 AS k, ordinal AS pos, sha256({S.dense_text('name', 'file', 'body')}) AS digest, max(ordinal) OVER () + 1 AS n FROM units
UNION ALL SELECT k + 1, pos // 256, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 255) // 256 FROM lv WHERE n > 1 GROUP BY k, pos // 256)
SELECT sha256('hashed-64' || 'False' || coalesce(max(digest), '')) AS fingerprint FROM lv WHERE n = 1""")
def fingerprint(spark, sf):
    from sieveline.plans.search import fingerprint as of

    return of(units(spark, sf).select("ordinal", T.dense_text("name", "file", "body").alias("text")), "hashed-64", False)


@query("config_overlay", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.ref'), 'none') AS ref FROM events""")
def config_overlay(spark, sf):
    """Defaults under each row's own options."""
    defaults = F.create_map(F.lit("k"), F.lit("none"), F.lit("ref"), F.lit("none"))
    merged = registry.overlay(defaults, F.from_json("props", "map<string,string>"))
    return table(spark, sf, "events").select("event_id", merged["k"].alias("k"), merged["ref"].alias("ref"))


@query("extract_units")
def extract_units(spark, sf):
    """Definitions of a C file made from each source of the documents."""
    code = F.concat(F.lit("/* "), F.coalesce("source", F.lit("none")), F.lit(" */\nstatic int f"), F.col("doc_id").cast("string"), F.lit("(int *v, int n)\n{\n    return add(v, n);\n}\n"))
    files = table(spark, sf, "documents").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("file"), code.cast("binary").alias("content"))
    return c_units.extract_units(files).select("id", "name", "start_line", "end_line", "signature", "comment", "is_static", F.array_join("calls", " ").alias("calls"))
