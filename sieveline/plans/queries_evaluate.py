"""Queries of benchmark construction, ranks, metrics, bootstrap, the run registry and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.functions import text as T
from sieveline.operators import evaluate, lexical, rank, training
from sieveline.operators.numbering import numbered
from sieveline.plans import bench
from sieveline.plans import queries_search as Q
from sieveline.plans import sql as S
from sieveline.plans.registering import query
from sieveline.plans.standins import UNITS, table, units
from sieveline.sources import registry, store
from sieveline.sources.scratch import new_path, written

_QUERIES = f"""texts AS (SELECT repo, ordinal, {S.query_text('comment')} AS text FROM units),
queries AS (SELECT repo, min(ordinal) AS query_id, text, min(ordinal) AS target FROM texts WHERE text IS NOT NULL GROUP BY repo, text HAVING count(*) = 1)"""


@query("build_queries", f"WITH {UNITS}, {_QUERIES} SELECT repo, query_id, text, target FROM queries")
def build_queries(spark, sf):
    return evaluate.build_queries(units(spark, sf))


# Ranks of benchmark targets by BM25: queries are the usable comments of all documents, targets their documents.
_RANKS = f"""WITH {UNITS}, {_QUERIES},
docs AS (SELECT ordinal, {S.tokenize("file || ' ' || body")} AS tokens FROM units),
q AS (SELECT query_id, target, repo, {S.tokenize('text')} AS tokens FROM queries),
{S.bm25('docs', 'q')},
every AS ({S.filled('bm', 'q', 'docs', 0)}), r AS ({S.ranked('every')}),
ranks AS (SELECT q.repo, q.query_id, q.target, r.rank FROM q JOIN r ON r.query_id = q.query_id AND r.ordinal = q.target)"""


def _ranks(spark, sf):
    own = units(spark, sf)
    docs = own.select("ordinal", T.tokenize(T.lexical_text("file", "body")).alias("tokens"))
    wanted = written(evaluate.build_queries(own), "wanted")
    found = lexical.target_ranks(docs, wanted.select("query_id", T.tokenize("text").alias("tokens")), wanted.select("query_id", "target"))
    return found.join(wanted.select("query_id", "repo"), "query_id").select("repo", "query_id", "target", "rank")


@query("query_ranks", f"{_RANKS} SELECT repo, query_id, target, rank FROM ranks")
def query_ranks(spark, sf):
    return _ranks(spark, sf)


_METRICS = "round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr"


def _rounded(df, *keys):
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")))


@query("retrieval_metrics", f"{_RANKS} SELECT repo, {_METRICS} FROM ranks GROUP BY repo")
def retrieval_metrics(spark, sf):
    return _rounded(evaluate.metrics(_ranks(spark, sf), "repo"), "repo")


@query("macro_average", f"{_RANKS}, m AS (SELECT repo, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS c, avg(1.0::DOUBLE / rank) AS m FROM ranks GROUP BY repo) SELECT round(avg(a), 6) AS recall_1, round(avg(b), 6) AS recall_5, round(avg(c), 6) AS recall_10, round(avg(m), 6) AS mrr FROM m")
def macro_average(spark, sf):
    return _rounded(evaluate.macro_average(evaluate.metrics(_ranks(spark, sf), "repo")))


def _method(rows: str, name: str, decimals: int) -> str:
    return f"{name}_every AS ({S.filled(rows, 'q', 'docs', 0)}), {name}_r AS ({S.ranked(name + '_every', decimals)})"


@query("bench_methods", f"""{Q._SEARCH}, {Q._EXPANDED}, {_method('bm', 'bm25', 9)}, {_method('dense', 'dn', 9)}, {_method('fused', 'hy', 12)}, {_method('expanded', 'gr', 12)},
ranks AS (SELECT 'bm25' AS method, rank FROM bm25_r WHERE ordinal = query_id UNION ALL SELECT 'dense', rank FROM dn_r WHERE ordinal = query_id UNION ALL SELECT 'hybrid', rank FROM hy_r WHERE ordinal = query_id UNION ALL SELECT 'hybrid_graph', rank FROM gr_r WHERE ordinal = query_id)
SELECT method, {_METRICS} FROM ranks GROUP BY method""")
def bench_methods(spark, sf):
    """Known-item search under all methods: the target of a query is its own document."""
    index, wanted = Q._index(spark, sf)
    ranks = bench.target_ranks(index, wanted, wanted.select("query_id", F.col("query_id").alias("target")))
    return _rounded(evaluate.metrics(ranks, "method"), "method")


def _draws(rows: str, resamples: int, by: str = "") -> str:
    """CTEs that end in spread(by, lo, hi, p_le_0) and diffs(by, diff): resamples of rows(by, grp, value, n)."""
    b, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    keys = ", ".join(f"{k}::VARCHAR" for k in [*filter(None, by.split(", ")), "grp", "value"])
    uniform = lambda at: f"(('0x' || substr(h, {at}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
    steps = ", ".join(f"[{', '.join(f'{x!r}::DOUBLE' for x in evaluate.poisson_steps(k))}]" for k in range(1, evaluate.MANY))
    return f"""bh AS (SELECT *, sha1(concat_ws('/', '0', resample::VARCHAR, {keys})) AS h FROM {rows} CROSS JOIN (SELECT unnest(range({resamples})) AS resample)),
bu AS (SELECT *, {uniform(1)} AS u1, {uniform(14)} AS u2 FROM bh),
bw AS (SELECT *, CASE WHEN n < {evaluate.MANY} THEN len(list_filter(([{steps}])[n], lambda s: s < u1))::DOUBLE ELSE greatest(0.0, round(n + sqrt(n) * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2))) END AS w FROM bu),
bs AS (SELECT {b}resample, grp, sum(w) AS w, sum(w * value) / 1e6 AS x FROM bw GROUP BY {b}resample, grp),
br AS (SELECT {b}resample, avg(x / w) AS m FROM bs WHERE w > 0 GROUP BY {b}resample),
spread AS (SELECT {b}quantile_cont(m, {(1 - C.CONFIDENCE) / 2}) AS lo, quantile_cont(m, {(1 + C.CONFIDENCE) / 2}) AS hi, avg(CASE WHEN round(m, 12) <= 0 THEN 1.0 ELSE 0.0 END) AS p_le_0 FROM br {group}),
diffs AS (SELECT {b}avg(mean) AS diff FROM (SELECT {b}grp, sum(n * value)::DOUBLE / sum(n) / 1e6 AS mean FROM {rows} GROUP BY {b}grp) {group})"""


_ROUND4 = "round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p_le_0, 6) AS p_le_0"


@query("paired_bootstrap", f"""WITH v AS (SELECT l_returnflag AS grp, round((l_discount - l_tax)::DOUBLE * 1000000)::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY ALL), {_draws('v', C.RESAMPLES)}
SELECT {_ROUND4} FROM diffs CROSS JOIN spread""")
def paired_bootstrap(spark, sf):
    """10,000 resamples of the paired differences of all line items, within three groups."""
    rows = table(spark, sf, "lineitem")
    values = rows.select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") - F.col("l_tax")).alias("diff"))
    return evaluate.bootstrap_table(values, C.RESAMPLES).select(*(F.round(c, 6).alias(c) for c in ("diff", "lo", "hi", "p_le_0")))


_ABLATION = """r AS (SELECT 'm' || (l_orderkey % 3) AS model, l_returnflag AS repo, l_linestatus AS method, l_partkey % 40 + 1 AS rank FROM lineitem),
m AS (SELECT model, repo, method, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS c, avg(1.0::DOUBLE / rank) AS m FROM r GROUP BY ALL),
t AS (SELECT model, method, avg(a) AS a, avg(c) AS c, avg(m) AS m FROM m GROUP BY ALL)"""


@query("ablation_table", f"WITH {_ABLATION} SELECT t.model, t.method, round(t.a, 6) AS recall_1, round(t.c, 6) AS recall_10, round(t.m, 6) AS mrr, round(t.m - b.m, 6) AS d_mrr, round(t.c - b.c, 6) AS d_recall_10 FROM t JOIN t b ON b.method = t.method AND b.model = 'm0'")
def ablation_table(spark, sf):
    """Three models' ranks (from line items) against the first one's."""
    rows = table(spark, sf, "lineitem")
    ranks = rows.select(F.concat(F.lit("m"), (F.col("l_orderkey") % 3).cast("string")).alias("model"), F.col("l_returnflag").alias("repo"), F.col("l_linestatus").alias("method"), (F.col("l_partkey") % 40 + 1).alias("rank"))
    return evaluate.ablation(ranks, "m0").select("model", "method", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_10", "mrr", "d_mrr", "d_recall_10")))


# Ranks of each line's query under three models: by its number, its quantity, its part.
_MODEL_RANKS = """mr AS (SELECT unnest(['m0', 'm1', 'm2']) AS model, l_returnflag AS repo, l_linestatus AS method, l_orderkey * 8 + l_linenumber AS query_no, unnest([l_linenumber * 2, l_quantity::BIGINT % 7 * 2 + 1, l_partkey % 5 * 3 + 1])::BIGINT AS rank FROM lineitem)"""


def _model_ranks(spark, sf):
    rows = table(spark, sf, "lineitem")
    ranks = {"m0": F.col("l_linenumber") * 2, "m1": F.col("l_quantity").cast("long") % 7 * 2 + 1, "m2": F.col("l_partkey") % 5 * 3 + 1}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), r.cast("long").alias("rank")) for m, r in ranks.items())))
    return rows.select(F.col("l_returnflag").alias("repo"), F.col("l_linestatus").alias("method"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("query_no"), each.alias("m")).select("m.model", "repo", "method", "query_no", "m.rank")


@query("ablation_intervals", f"""WITH {_MODEL_RANKS}, pr AS (SELECT a.model, a.method, a.repo AS grp, unnest(['mrr', 'recall_10']) AS metric, unnest([1.0::DOUBLE / a.rank - 1.0::DOUBLE / b.rank, CASE WHEN a.rank <= 10 THEN 1.0::DOUBLE ELSE 0.0 END - CASE WHEN b.rank <= 10 THEN 1.0::DOUBLE ELSE 0.0 END]) AS d
  FROM mr a JOIN mr b ON b.model = 'm0' AND a.model <> 'm0' AND a.repo = b.repo AND a.method = b.method AND a.query_no = b.query_no),
v AS (SELECT model, method, metric, grp, round(d * 1000000)::BIGINT AS value, count(*) AS n FROM pr GROUP BY ALL), {_draws('v', 1_000, 'model, method, metric')}
SELECT d.model, d.method, d.metric, {_ROUND4} FROM diffs d JOIN spread s ON s.model = d.model AND s.method = d.method AND s.metric = d.metric""")
def ablation_intervals(spark, sf):
    """Two models against a third one, by method and metric, in 1,000 resamples of all lines."""
    found = evaluate.ablation_intervals(_model_ranks(spark, sf), "m0", 1_000)
    return found.select("model", "method", "metric", *(F.round(c, 6).alias(c) for c in ("diff", "lo", "hi", "p_le_0")))


@query("ablation_by_repo", f"WITH {_MODEL_RANKS} SELECT model, method, " + ", ".join(f"round(avg(1.0::DOUBLE / rank) FILTER (WHERE repo = '{r}'), 6) AS {r}" for r in "ANR") + " FROM mr GROUP BY model, method")
def ablation_by_repo(spark, sf):
    found = evaluate.mrr_by_repo(_model_ranks(spark, sf), ["A", "N", "R"])
    return found.select("model", "method", *(F.round(c, 6).alias(c) for c in "ANR"))


@query("rank_dump", f"WITH {_MODEL_RANKS} SELECT model, repo, method, row_number() OVER (PARTITION BY model, repo, method ORDER BY query_no, rank) - 1 AS query_no, rank FROM mr WHERE query_no % 100 = 0")
def rank_dump(spark, sf):
    """The ranks of every hundredth query, numbered, as a dump that is written and read again."""
    ranks = numbered(_model_ranks(spark, sf).where("query_no % 100 = 0").withColumnRenamed("query_no", "key"), ["key", "rank"], ["model", "repo", "method"], "query_no")
    path = new_path(spark, "dump")
    evaluate.rank_dump(ranks).write.text(path)
    return evaluate.ranks_table(spark, path).select("model", "repo", "method", F.col("query_no").cast("long").alias("query_no"), F.col("rank").cast("long").alias("rank"))


# ---- runs: a user is a run, an event type a metric, an event's time a step
@query("metric_history", "SELECT user_id AS run_id, event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, value FROM events")
def metric_history(spark, sf):
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), step.cast("long").alias("step"), "value")


_RUNS = """runs AS (SELECT user_id::VARCHAR AS run_id, CASE WHEN user_id % 5 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status, CASE user_id % 2 WHEN 0 THEN 'hard' ELSE 'random' END AS tag, min(ts) AS start_time, CASE WHEN user_id % 7 <> 0 THEN '/runs/' || user_id || '/model' END AS artifact FROM events GROUP BY user_id),
final AS (SELECT user_id::VARCHAR AS run_id, max_by(value, event_id) AS final_val_mrr FROM events WHERE event_type = 'click' GROUP BY user_id),
found AS (SELECT run_id, tag, artifact, start_time, final_val_mrr FROM runs JOIN final USING (run_id) WHERE status = 'FINISHED' AND artifact IS NOT NULL)"""


def _runs(spark, sf):
    events = table(spark, sf, "events")
    user = F.col("user_id")
    runs = events.groupBy("user_id").agg(F.min("ts").alias("start_time")).select(
        user.cast("string").alias("run_id"), F.when(user % 5 == 0, "FAILED").otherwise("FINISHED").alias("status"), F.when(user % 2 == 0, "hard").otherwise("random").alias("tag"), "start_time",
        F.when(user % 7 != 0, F.concat(F.lit("/runs/"), user.cast("string"), F.lit("/model"))).alias("artifact"),
    )
    metrics = events.where("event_type = 'click'").select(user.cast("string").alias("run_id"), F.lit("final_val_mrr").alias("key"), F.col("event_id").alias("step"), "value")
    return runs, metrics


@query("find_runs", f"WITH {_RUNS} SELECT run_id, tag, artifact, final_val_mrr, row_number() OVER (ORDER BY final_val_mrr DESC, start_time DESC, run_id) AS place FROM found")
def find_runs(spark, sf):
    found = registry.finished_runs(*_runs(spark, sf))
    placed = numbered(found, [F.desc("final_val_mrr"), F.desc("start_time"), "run_id"], name="place")
    return placed.select("run_id", "tag", "artifact", "final_val_mrr", (F.col("place") + 1).alias("place"))


@query("best_run", f"WITH {_RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY final_val_mrr DESC, start_time DESC, run_id) AS place FROM found) SELECT 'mlflow:best-' || tag AS spec, artifact FROM p WHERE place = 1")
def best_run(spark, sf):
    runs, metrics = _runs(spark, sf)
    found = registry.finished_runs(runs, metrics)
    first = F.struct(-F.col("final_val_mrr"), -F.unix_micros(F.col("start_time").cast("timestamp")), F.col("run_id"))
    best = found.groupBy("tag").agg(F.min_by("artifact", first).alias("artifact"))
    return best.select(F.concat(F.lit("mlflow:best-"), "tag").alias("spec"), "artifact")


@query("train_metric_log")
def train_metric_log(spark, sf):
    """What a training run over all pairs of vectors has logged: loss and rate by step, and the validation figure, read from its run log."""
    log = registry.RunLog(spark, new_path(spark, "runs"))
    pairs = Q._vector_pairs(spark, sf).select("pair_id", F.col("q").cast("array<double>").alias("q"), F.col("d").cast("array<double>").alias("d"))
    options = training.Options(batch_size=16, steps=8)
    with log.run("vectors", options._asdict()) as report:
        training.train(pairs, options, report)
    return log.metrics().where("run_id = 'vectors'").select("key", "step", F.round("value", 6).alias("value"))


@query("report_rows", f"{_RANKS}, m AS (SELECT repo, {_METRICS} FROM ranks GROUP BY repo) SELECT printf('| %s | BM25 (baseline) | %.3f | %.3f | %.3f | %.3f |', repo, recall_1, recall_5, recall_10, mrr) AS line FROM m")
def report_rows(spark, sf):
    figures = _rounded(evaluate.metrics(_ranks(spark, sf), "repo"), "repo")
    # Java rounds the shortest decimal half up, where printf in SQL rounds the number itself, half to even: 0.0625 is 0.062.
    digits = F.udf(lambda x: f"{x:.3f}")
    return figures.select(F.format_string("| %s | BM25 (baseline) | %s | %s | %s | %s |", "repo", *map(digits, ("recall_1", "recall_5", "recall_10", "mrr"))).alias("line"))


@query("pairs_roundtrip")
def pairs_roundtrip(spark, sf):
    """Pairs written as JSON lines and read again."""
    from sieveline.operators import mining

    kept = mining.mining_funnel(units(spark, sf)).where("reason IS NULL").select("repo", F.col("id").alias("unit_id"), "query", "code", "split", F.lit("").alias("negative"))
    path = new_path(spark, "pairs")
    store.save_pairs(kept, path)
    return store.load_pairs(spark, path)


@query("ordered_ranks", "SELECT query_id, ordinal, rank FROM (SELECT lang AS query_id, doc_id AS ordinal, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 100")
def ordered_ranks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("ordinal"), F.col("n_chars").cast("double").alias("score"))
    return rank.rank_order(docs, C.FUSION_DEPTH).select("query_id", "ordinal", F.col("rank").cast("long").alias("rank"))
