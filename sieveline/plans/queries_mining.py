"""Queries of the guards, the mining funnel, negatives and the leak audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.functions import text as T
from sieveline.operators import mining
from sieveline.plans import sql as S
from sieveline.plans.registering import query
from sieveline.plans.standins import UNITS, table, units
from sieveline.sources.scratch import written

# Lines of documents are comments to be guarded; benchmark items are what they must not overlap with.
_LINES = "ls AS (SELECT doc_id * 1000000 + i AS a, x FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM d)) WHERE x <> '')"
_BENCH = "bl AS (SELECT DISTINCT x FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE x <> '')"


def _lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return docs.where("x <> ''").select((F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("a"), "x")


def _bench(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("x")).where("x <> ''").distinct()


@query("guard_exact", f"WITH {UNITS}, {_LINES}, {_BENCH} SELECT a FROM ls WHERE {S.squeeze('lower(x)')} IN (SELECT {S.squeeze('lower(x)')} FROM bl)")
def guard_exact(spark, sf):
    keys = _bench(spark, sf).select(mining.normal_comment("x").alias("k")).distinct()
    return _lines(spark, sf).withColumn("k", mining.normal_comment("x")).join(keys, "k", "left_semi").select("a")


_SETS = f"l AS (SELECT a, {S.shingles('t', 3)} AS shingles FROM (SELECT a, {S.comment_words('x')} AS t FROM ls)), r AS (SELECT row_number() OVER () AS b, {S.shingles('t', 3)} AS shingles FROM (SELECT {S.comment_words('x')} AS t FROM bl))"


@query("max_jaccard", f"WITH {UNITS}, {_LINES}, {_BENCH}, {_SETS}, {S.max_jaccard('l', 'r', 'mj')} SELECT a, round(j, 6) AS j FROM mj")
def max_jaccard(spark, sf):
    left = _lines(spark, sf).select("a", T.hashed_comment_shingles("x").alias("shingles"))
    right = _bench(spark, sf).select(T.hashed_comment_shingles("x").alias("shingles"))
    return mining.max_jaccard(left, right).select("a", F.round("j", 6).alias("j"))


@query("guard_reason", f"""WITH {UNITS}, {_LINES}, {_BENCH}, {_SETS}, {S.max_jaccard('l', 'r', 'mj')}, e AS (SELECT DISTINCT {S.squeeze('lower(x)')} AS k FROM bl)
SELECT a, CASE WHEN {S.squeeze('lower(x)')} IN (SELECT k FROM e) THEN 'benchmark_comment_exact' WHEN j >= {C.COMMENT_JACCARD} THEN 'benchmark_comment_near' END AS reason FROM ls JOIN mj USING (a)""")
def guard_reason(spark, sf):
    return mining.comment_reasons(_lines(spark, sf), _bench(spark, sf))


@query("disjoint_repos", "WITH t AS (SELECT 'r' || page_id AS name, url FROM pages WHERE page_id % 3 <> 0), b AS (SELECT 'R' || (page_id + 1) AS name, upper(url) || '.git' AS url FROM pages WHERE page_id % 50 = 0), k AS (SELECT lower(name) AS key FROM b UNION SELECT regexp_replace(lower(url), '\\.git$', '') FROM b) SELECT name FROM t WHERE lower(name) IN (SELECT key FROM k) OR regexp_replace(lower(url), '\\.git$', '') IN (SELECT key FROM k)")
def disjoint_repos(spark, sf):
    pages = table(spark, sf, "pages")
    training = pages.where("page_id % 3 <> 0").select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("name"), "url")
    bench = pages.where("page_id % 50 = 0").select(F.concat(F.lit("R"), (F.col("page_id") + 1).cast("string")).alias("name"), F.concat(F.upper("url"), F.lit(".git")).alias("url"))
    return mining.overlapping_repos(training, bench)


_FUNNEL = f"""g AS (SELECT *, {S.dense_text('name', 'file', 'body')} AS code, {S.query_text('comment')} AS query, {S.split_of('repo', 'file')} AS split FROM units),
h AS (SELECT *, sha1({S.normalise_code('code')}) AS hash FROM g),
c AS (SELECT *, row_number() OVER (PARTITION BY repo, hash ORDER BY ordinal) > 1 AS copy FROM h),
bb AS (SELECT row_number() OVER () AS b, text FROM benchmark),
cx AS (SELECT ordinal AS a, {S.shingles('t', 5)} AS shingles FROM (SELECT ordinal, {S.code_tokens('code')} AS t FROM c WHERE NOT copy)),
cy AS (SELECT b, {S.shingles('t', 5)} AS shingles FROM (SELECT b, {S.code_tokens('text')} AS t FROM bb)),
{S.max_jaccard('cx', 'cy', 'cj')},
qx AS (SELECT ordinal AS a, {S.shingles('t', 3)} AS shingles FROM (SELECT ordinal, {S.comment_words('comment')} AS t FROM c WHERE NOT copy)),
qy AS (SELECT b, {S.shingles('t', 3)} AS shingles FROM (SELECT b, {S.comment_words('text')} AS t FROM bb)),
{S.max_jaccard('qx', 'qy', 'qj')},
f AS (SELECT c.*, CASE WHEN copy THEN 'duplicate_code' WHEN hash IN (SELECT sha1({S.normalise_code('text')}) FROM bb) THEN 'benchmark_code_exact' WHEN cj.j >= {C.CODE_JACCARD} THEN 'benchmark_code_near'
  WHEN query IS NULL THEN 'no_query' WHEN n_lines < {C.MIN_BODY_LINES} THEN 'too_short' WHEN {S.squeeze('lower(comment)')} IN (SELECT {S.squeeze('lower(text)')} FROM bb) THEN 'benchmark_comment_exact'
  WHEN qj.j >= {C.COMMENT_JACCARD} THEN 'benchmark_comment_near' END AS reason FROM c LEFT JOIN cj ON cj.a = ordinal LEFT JOIN qj ON qj.a = ordinal),
funnel AS (SELECT repo, ordinal, id, file, query, code, hash, split, CASE WHEN reason IS NULL AND count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY repo, query) > 1 THEN 'duplicate_comment' ELSE reason END AS reason,
  reason IS NULL OR reason NOT IN ('duplicate_code', 'benchmark_code_exact', 'benchmark_code_near') AS in_pool FROM f)"""
_MINED = f"WITH {UNITS}, {_FUNNEL}"


def _funnel(spark, sf):
    bench = table(spark, sf, "benchmark").select(F.lit("").alias("name"), F.lit("").alias("file"), F.col("text").alias("comment"), "text")
    return written(mining.mining_funnel(units(spark, sf), bench.select("name", "file", "comment", F.col("text").alias("body"))), "funnel")


@query("mining_funnel", f"{_MINED} SELECT repo, ordinal, query, split, reason, in_pool FROM funnel")
def mining_funnel(spark, sf):
    return _funnel(spark, sf).select("repo", "ordinal", "query", "split", "reason", "in_pool")


@query("mining_stats", f"""{_MINED} SELECT repo, count(*) AS functions, count(*) FILTER (WHERE in_pool AND query IS NOT NULL) AS with_query, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ('benchmark_code_exact', 'benchmark_code_near', 'benchmark_comment_exact', 'benchmark_comment_near', 'duplicate_code', 'duplicate_comment', 'too_short'))}, count(*) FILTER (WHERE reason IS NULL) AS kept FROM funnel GROUP BY repo""")
def mining_stats(spark, sf):
    return mining.mining_stats(_funnel(spark, sf))


@query("dedupe_first", f"WITH {UNITS}, h AS (SELECT repo, ordinal, sha1({S.normalise_code('text')}) AS hash FROM units) SELECT repo, min(ordinal) AS ordinal, hash, count(*) AS copies FROM h GROUP BY repo, hash")
def dedupe_first(spark, sf):
    own = units(spark, sf).select("repo", "ordinal", T.code_hash("text").alias("hash"))
    return own.groupBy("repo", "hash").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("copies"))


@query("ambiguous_queries", f"{_MINED} SELECT repo, query, count(*) AS n FROM funnel WHERE reason = 'duplicate_comment' GROUP BY repo, query")
def ambiguous_queries(spark, sf):
    return _funnel(spark, sf).where("reason = 'duplicate_comment'").groupBy("repo", "query").agg(F.count("*").alias("n"))


def _at(*parts: str) -> str:
    return f"('0x' || substr(sha1(concat_ws('/', '0', {', '.join(parts)})), 1, 8))::BIGINT"


_RANDOM = f"""n AS (SELECT p.repo, p.split, p.id, c.id AS negative, row_number() OVER (PARTITION BY p.repo, p.split, p.id ORDER BY ({_at('c.id')} < {_at("'pair'", 'p.id')})::INT, {_at('c.id')}, c.id) AS nth
  FROM funnel p JOIN funnel c ON c.repo = p.repo AND c.split = p.split AND c.in_pool AND c.hash <> p.hash AND c.id <> p.id WHERE p.reason IS NULL)"""


@query("random_negatives", f"{_MINED}, {_RANDOM} SELECT repo, split, id, negative FROM n WHERE nth = 1")
def random_negatives(spark, sf):
    own = _funnel(spark, sf)
    return mining.random_negatives(own.where("reason IS NULL"), own.where("in_pool"))


_HARD = f"""pool AS (SELECT repo || '/' || split AS grp, ordinal, id, hash, {S.tokenize("file || ' ' || substr(code, length(split_part(code, chr(10), 1)) + 2)")} AS tokens FROM funnel WHERE in_pool),
hq AS (SELECT repo || '/' || split AS grp, repo, split, ordinal AS query_id, id, hash, {S.tokenize('query')} AS tokens FROM funnel WHERE reason IS NULL),
{S.bm25('pool', 'hq', 'grp')},
ok AS (SELECT hq.query_id, hq.repo, hq.split, pool.ordinal, coalesce(bm.score, 0.0) AS score, hq.id, pool.id AS negative FROM hq JOIN pool ON pool.grp = hq.grp LEFT JOIN bm ON bm.query_id = hq.query_id AND bm.ordinal = pool.ordinal WHERE pool.hash <> hq.hash AND pool.id <> hq.id),
r AS ({S.ranked('ok')}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha1(concat_ws('/', '0', id, negative)), negative) AS nth FROM r WHERE rank <= 10)"""


@query("hard_negatives", f"{_MINED}, {_HARD} SELECT query_id, negative FROM t WHERE nth = 1")
def hard_negatives(spark, sf):
    """For the pairs of every language and split, by the whole text."""
    own = _funnel(spark, sf)
    return _hard_negatives(own.where("reason IS NULL"), own.where("in_pool")).select("query_id", "negative")


def _hard_negatives(kept, pool):
    return mining.hard_negatives(kept.withColumn("query_id", F.col("ordinal")).withColumn("tokens", T.tokenize("query")), pool.withColumn("tokens", mining.lexical_tokens("id", "code")))


@query("mine_all", f"""{_MINED}, {_RANDOM}, {_HARD} SELECT 'random' AS mode, f.repo, f.id, f.query, f.split, n.negative FROM funnel f LEFT JOIN n ON n.id = f.id AND n.repo = f.repo AND n.nth = 1 WHERE reason IS NULL
UNION ALL SELECT 'hard', f.repo, f.id, f.query, f.split, t.negative FROM funnel f LEFT JOIN t ON t.query_id = f.ordinal AND t.nth = 1 WHERE reason IS NULL""")
def mine_all(spark, sf):
    """The pairs of all languages with negatives of both modes."""
    own = _funnel(spark, sf)
    kept, pool = own.where("reason IS NULL"), own.where("in_pool")
    total = None
    for mode in C.NEGATIVE_MODES:
        pairs = kept.select("repo", "split", "id", "query").join(mining.negatives(kept, pool, mode), ["repo", "split", "id"], "left")
        pairs = pairs.select(F.lit(mode).alias("mode"), "repo", "id", "query", "split", "negative")
        total = pairs if total is None else total.unionByName(pairs)
    return total


@query("find_leaks", f"""WITH {UNITS}, {_LINES}, {_BENCH}, {_SETS}, {S.max_jaccard('l', 'r', 'mj')}, e AS (SELECT DISTINCT {S.squeeze('lower(x)')} AS k FROM bl)
SELECT a AS unit_id, CASE WHEN {S.squeeze('lower(x)')} IN (SELECT k FROM e) THEN 'benchmark_comment_exact' ELSE 'benchmark_comment_near' END AS reason FROM ls JOIN mj USING (a) WHERE {S.squeeze('lower(x)')} IN (SELECT k FROM e) OR j >= {C.COMMENT_JACCARD}""")
def find_leaks(spark, sf):
    """Lines of documents as queries of pairs whose code is their number: only the queries can leak."""
    pairs = _lines(spark, sf).select(F.col("a").alias("unit_id"), F.col("x").alias("query"), F.concat(F.lit("unit "), F.col("a").cast("string")).alias("code"), F.lit("").alias("negative"))
    bench = _bench(spark, sf).select(F.lit("no code at all of any such unit").alias("code"), F.col("x").alias("comment"))
    return mining.find_leaks(pairs, bench)


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY sha1('7/' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf):
    return mining.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


@query("manifest")
def manifest(spark, sf):
    """The repository manifest as a dimension table."""
    rows = [("benchmark", *r) for r in C.PINNED] + [("training", *r) for r in C.TRAINING]
    return spark.createDataFrame(rows, "role string, name string, url string, commit string, tag string, license string, paths array<string>")
