"""Rankings: total order, weighted reciprocal-rank fusion, one-hop graph expansion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.sources.scratch import written

#: Scores are ranked at these decimals, so that the order in which a sum ran can't decide.
RAW_DECIMALS, FUSED_DECIMALS = 9, 12


def rank_order(scored: DataFrame, k: int | None = None, decimals: int = RAW_DECIMALS) -> DataFrame:
    """query_id, ordinal, score -> with rank: by score descending, then ordinal; the first k."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", decimals).desc(), F.col("ordinal"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def fill(scored: DataFrame, queries: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """Documents without a score have 0 and stay in the ranking by ordinal. Only the least `depth` ordinals can get into the first
    `depth` places that way, so no more are added."""
    least = docs.select("ordinal").orderBy("ordinal").limit(depth)  # depth rows at most
    zeros = queries.select("query_id").crossJoin(F.broadcast(least)).withColumn("score", F.lit(0.0))
    return scored.select("query_id", "ordinal", "score").unionByName(zeros).groupBy("query_id", "ordinal").agg(F.sum("score").alias("score"))


def rrf(rankings: Sequence[DataFrame], k: int = C.RRF_K, depth: int | None = None, weights: Sequence[float] | None = None) -> DataFrame:
    """Rankings (query_id, ordinal, rank) -> query_id, ordinal, score = sum of w / (k + rank); what is beyond depth gives nothing."""
    weights = [1.0] * len(rankings) if weights is None else list(weights)
    if len(weights) != len(rankings):
        raise ValueError("one weight for each ranking")
    total = None
    for ranking, weight in zip(rankings, weights, strict=True):
        own = ranking.where(F.col("rank") <= depth) if depth else ranking
        own = own.select("query_id", "ordinal", (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("score"))
        total = own if total is None else total.unionByName(own)
    return total.groupBy("query_id", "ordinal").agg(F.sum("score").alias("score"))


def graph_expand(fused: DataFrame, neighbours: Callable[[DataFrame], DataFrame], seeds: int = C.GRAPH_SEEDS, weight: float = C.GRAPH_WEIGHT) -> DataFrame:
    """query_id, ordinal, score -> scores with the best hits' neighbours raised and the hits kept on top. neighbours gives (a, b) for a table of those a that are hits: no
    others' edges are made.

    A seed shares weight * score among its neighbours but itself; other seeds count in the number of neighbours and get nothing. Where
    another document reaches the least seed, all seeds are lifted above it.
    """
    fused = written(fused.select("query_id", "ordinal", "score"), "fused")
    top = written(rank_order(fused.where("score > 0"), seeds, FUSED_DECIMALS).select("query_id", F.col("ordinal").alias("seed"), F.col("score").alias("seed_score")), "seeds")
    mine = written(neighbours(top.select(F.col("seed").alias("a")).distinct()).where("a <> b").select("a", "b").distinct(), "seed-edges")
    degree = mine.groupBy("a").agg(F.count("*").alias("degree"))
    gains = top.join(mine.join(degree, "a"), F.col("seed") == F.col("a")).select("query_id", F.col("b").alias("ordinal"), (weight * F.col("seed_score") / F.col("degree")).alias("score"))
    marks = top.select("query_id", F.col("seed").alias("ordinal"), F.lit(True).alias("is_seed"))
    gains = gains.join(marks, ["query_id", "ordinal"], "left_anti")
    raised = fused.select("query_id", "ordinal", "score").unionByName(gains).groupBy("query_id", "ordinal").agg(F.sum("score").alias("score"))
    raised = raised.join(marks, ["query_id", "ordinal"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    query = Window.partitionBy("query_id")
    rest = F.max(F.when(~F.col("is_seed"), F.col("score"))).over(query)
    least = F.min(F.when(F.col("is_seed"), F.col("score"))).over(query)
    lift = F.when(F.col("is_seed") & (rest >= least), rest - least + C.SEED_LIFT).otherwise(0.0)
    return raised.select("query_id", "ordinal", (F.col("score") + lift).alias("score"))
