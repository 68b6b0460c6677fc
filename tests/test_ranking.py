import math

import numpy as np
import pytest

from sieveline.functions import text
from sieveline.operators import dense, evaluate, lexical, rank
from sieveline.plans import queries_evaluate, queries_search
from sieveline.plans.standins import units


def ranking(spark, order):
    return spark.createDataFrame([(0, d, r) for r, d in enumerate(order, 1)], "query_id long, ordinal long, rank int")


def as_dict(df):
    return {r.ordinal: r.score for r in df.collect()}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["c", "c", "b"])], "ordinal long, tokens array<string>")
    asked = spark.createDataFrame([(0, ["b"]), (1, ["c", "b", "c"]), (2, ["zz"])], "query_id long, tokens array<string>")

    def part(tf, length, df):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 2))

    found = {(r.query_id, r.ordinal): r.score for r in lexical.scores(docs, asked).collect()}
    assert found == pytest.approx({(0, 0): part(1, 2, 2), (0, 2): part(1, 3, 2), (1, 0): part(1, 2, 2), (1, 2): part(2, 3, 1) + part(1, 3, 2)})
    assert lexical.scores(docs.limit(0), asked).count() == 0


@pytest.mark.parametrize("seed", [11, 12])
def test_order_is_that_of_a_plain_sort(spark, seed):
    draw = np.random.default_rng(seed)
    scores = np.round(draw.choice([0.0, 0.25, 0.7, 1.3], (3, 17)), 2)
    scored = spark.createDataFrame([(q, i, float(x)) for q, row in enumerate(scores) for i, x in enumerate(row)], "query_id long, ordinal long, score double")
    got = rank.rank_order(scored, 9).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ordinal) for r in got] == [(q, i) for q, row in enumerate(scores) for i in sorted(range(17), key=lambda i: (-row[i], i))[:9]]


@pytest.mark.parametrize(("k", "depth", "weights"), [(60, None, None), (7, 4, None), (60, 6, [0.5, 3.0, 1.0])])
def test_fusion_is_the_plain_sum(spark, k, depth, weights):
    draw = np.random.default_rng(k)
    orders = [draw.permutation(15)[: int(draw.integers(3, 15))].tolist() for _ in range(3)]
    want = {}
    for order, weight in zip(orders, weights or [1.0] * 3, strict=True):
        for place, d in enumerate(order[:depth], 1):
            want[d] = want.get(d, 0.0) + weight / (k + place)
    rankings = [ranking(spark, order) for order in orders]
    assert as_dict(rank.rrf(rankings, k=k, depth=depth, weights=weights)) == pytest.approx(want)
    with pytest.raises(ValueError, match="weight"):
        rank.rrf(rankings, weights=[1.0, 2.0])


def plain_expansion(scores, near, seeds):
    """One hop from the best hits, a document at a time."""
    best = sorted((d for d in scores if scores[d] > 0), key=lambda d: (-scores[d], d))[:seeds]
    out = dict(scores)
    for s in best:
        around = near.get(s, set()) - {s}
        for d in around - set(best):
            out[d] = out.get(d, 0.0) + 0.5 * scores[s] / len(around)
    others = [x for d, x in out.items() if d not in best]
    if best and others and max(others) >= min(scores[s] for s in best):
        gap = max(others) - min(scores[s] for s in best) + 1e-9
        out |= {s: out[s] + gap for s in best}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_expansion_is_the_plain_one(spark, seed):
    draw = np.random.default_rng(seed)
    scores = {d: float(draw.choice([0.0, 0.11, 0.32, 0.58])) for d in range(12)}
    near = {}
    for a, b in draw.integers(0, 12, (14, 2)).tolist():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    fused = spark.createDataFrame([(0, d, x) for d, x in scores.items()], "query_id long, ordinal long, score double")
    edges = spark.createDataFrame([(a, b) for a, x in near.items() for b in x], "a long, b long")
    assert as_dict(rank.graph_expand(fused, lambda asked: edges.join(asked, "a"), 3)) == pytest.approx(plain_expansion(scores, near, 3))


def test_metrics_and_transforms(spark):
    ranks = spark.createDataFrame([(r,) for r in (1, 2, 6, 20)], "rank int")
    row = evaluate.metrics(ranks).first()
    assert (row.recall_1, row.recall_5, row.recall_10) == (0.25, 0.5, 0.75) and row.mrr == pytest.approx((1 + 1 / 2 + 1 / 6 + 1 / 20) / 4)
    assert tuple(evaluate.metrics(ranks.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_ranks_of_unscored_targets(spark):
    scored = spark.createDataFrame([(0, 5, 2.0), (0, 1, 2.0), (0, 7, 0.5)], "query_id long, ordinal long, score double")
    for target, want in ((1, 1), (5, 2), (7, 3), (0, 4), (2, 5), (3, 6), (4, 7), (6, 8), (8, 9)):
        asked = spark.createDataFrame([(0, target)], "query_id long, target long")
        assert evaluate.target_ranks(scored, asked).first()["rank"] == want


def test_queries_name_one_unit(spark):
    units = spark.createDataFrame([("r", 0, "short one"), ("r", 1, "twice told tale here"), ("r", 2, "twice told tale here"), ("r", 3, "the only such long comment"), ("s", 0, "twice told tale here")], "repo string, ordinal long, comment string")
    assert sorted((r.repo, r.target) for r in evaluate.build_queries(units).collect()) == [("r", 3), ("s", 0)]


def test_bootstrap(spark):
    x = [np.array([0.1, 0.5, 0.9]), np.array([0.2, 0.4])]
    assert evaluate.paired_bootstrap(x, x, 200) == {"diff": 0.0, "lo": 0.0, "hi": 0.0, "p_le_0": 1.0}
    up = evaluate.paired_bootstrap(x, [v + 0.1 for v in x], 200)
    assert (up["diff"], up["lo"], up["hi"]) == pytest.approx((0.1, 0.1, 0.1)) and up["p_le_0"] == 0
    assert evaluate.paired_bootstrap([np.zeros(4), np.zeros(100)], [np.ones(4), np.zeros(100)], 50)["diff"] == pytest.approx(0.5)
    with pytest.raises(ValueError, match="same"):
        evaluate.paired_bootstrap([np.zeros(2)], [np.zeros(3)])
    values = spark.createDataFrame([("a", 0.25)] * 12 + [("b", 0.75)] * 9 + [("b", None)], "grp string, diff double")
    assert tuple(evaluate.bootstrap_table(values, 50).first()) == pytest.approx((0.5, 0.5, 0.5, 0.0))
    assert evaluate.bootstrap_table(values.limit(0), 50).first().diff is None


@pytest.mark.parametrize("parts", [1, 5])
def test_distributed_bootstrap_is_the_plain_one(spark, parts):
    """Against resampling with replacement on the driver; and the same whatever the partitioning."""
    draw = np.random.default_rng(2)
    groups = {"a": np.round(draw.normal(0.1, 1, 400), 1), "b": np.round(draw.normal(0.0, 2, 300), 1)}
    values = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "grp string, diff double").repartition(parts)
    own = evaluate.bootstrap_table(values, 4000).first()
    plain = evaluate.paired_bootstrap([np.zeros(len(v)) for v in groups.values()], list(groups.values()), 4000)
    assert own.diff == pytest.approx(plain["diff"]) and own.lo == pytest.approx(plain["lo"], abs=0.02) and own.hi == pytest.approx(plain["hi"], abs=0.02) and own.p_le_0 == pytest.approx(plain["p_le_0"], abs=0.04)
    assert tuple(own) == pytest.approx(tuple(evaluate.bootstrap_table(values.coalesce(1), 4000).first()), abs=1e-9)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "x array<float>, z array<float>").select(dense.l2_normalise("x"), dense.l2_normalise("z")).first()
    assert row[0] == pytest.approx([0.6, 0.8]) and row[1] == [0.0, 0.0]
    texts = spark.createDataFrame([(0, "a b c"), (1, None)], "i long, t string")
    assert [len(r[0]) for r in texts.select(dense.embed_column("t")).collect()] == [64, 64]


@pytest.mark.parametrize("block_bytes", [32_000_000, 300])
def test_ranks_and_losses_against_all_pairs(spark, block_bytes):
    draw = np.random.default_rng(3)
    q, d = (np.round(draw.normal(size=(45, 6)), 1) for _ in range(2))
    d[7] = d[9] = d[30]
    pairs = spark.createDataFrame([(i, q[i].tolist(), d[i].tolist()) for i in range(45)], "pair_id long, q array<double>, d array<double>")
    products = q @ d.T
    ranks = {r.pair_id: r["rank"] for r in dense.validation_ranks(pairs, block_bytes).collect()}
    assert ranks == {i: 1 + sum(round(x, 9) > round(products[i, i], 9) for x in products[i]) for i in range(45)}
    losses = {r.pair_id: r.loss for r in dense.mnr_loss(pairs, 5.0, block_bytes).collect()}
    assert losses == pytest.approx({i: math.log(sum(math.exp(5 * x) for x in products[i])) - 5 * products[i, i] for i in range(45)})
    assert dense.validation_ranks(pairs.limit(0)).count() == 0 and dense.mnr_loss(pairs.limit(0)).count() == 0


def test_every_vector_is_paired(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    pairs = {i for i in ids if i + 1 in ids}
    assert {r.pair_id for r in queries_search.mnr_loss(spark, sf).collect()} == pairs and queries_search.validation_mrr(spark, sf).first().n == len(pairs)
    assert sorted((r.key, r.step) for r in queries_evaluate.train_metric_log(spark, sf).collect()) == [(key, step) for key in ("learning_rate", "train_loss") for step in range(1, 9)]


def test_rank_dump(spark, tmp_path):
    path = tmp_path / "ranks.json"
    path.write_text('{"models": {}, "ranks": {"m": {"r": {"dense": [1, 4]}}, "n": {"r": {"dense": [1, 1]}}}}')
    ranks = evaluate.ranks_table(spark, str(path))
    rows = {r.model: r for r in evaluate.ablation(ranks, "m").collect()}
    assert rows["m"].mrr == pytest.approx(0.625) and rows["n"].d_mrr == pytest.approx(0.375) and rows["n"].recall_1 == 1.0


@pytest.mark.parametrize("name", ["query_ranks", "retrieval_metrics", "macro_average", "report_rows"])
def test_every_query_is_ranked(spark, sf, name):
    """No figure comes from a part of the queries: ranks, means of a repository, means of those, and the report's lines are those of all of them."""
    asked = evaluate.build_queries(units(spark, sf))
    ranks = lexical.target_ranks(units(spark, sf).select("ordinal", text.tokenize(text.lexical_text("file", "body")).alias("tokens")), asked.select("query_id", text.tokenize("text").alias("tokens")), asked.select("query_id", "target"))
    ranks = {(r.repo, r.query_id): r["rank"] for r in ranks.join(asked.select("query_id", "repo"), "query_id").collect()}
    assert any(i % 100 for _, i in ranks)
    mrr = {repo: np.mean([1 / r for (own, _), r in ranks.items() if own == repo]) for repo in {repo for repo, _ in ranks}}
    rows = getattr(queries_evaluate, name)(spark, sf).collect()
    if name == "query_ranks":
        assert {(r.repo, r.query_id): r["rank"] for r in rows} == ranks
    elif name == "macro_average":
        assert rows[0].mrr == pytest.approx(np.mean(list(mrr.values())), abs=1e-6)
    elif name == "retrieval_metrics":
        assert {r.repo: r.mrr for r in rows} == pytest.approx(mrr, abs=1e-6)
    else:
        assert sorted(r.line[-8:] for r in rows) == sorted(f" {m:.3f} |" for m in mrr.values())
