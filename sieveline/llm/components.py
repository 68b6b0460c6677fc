"""Connected components of an edge table, distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node of it) for each node of edges (two long columns); edges may be in any direction and repeated.

    Each step keeps the components, and a step's edges are no more than those before it. The lineage is cut at each step. Least
    neighbours are joined as written tables, so that a node of very many edges can be split.
    """
    own = _checked(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _checked(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # Only stars are left when each node is less than all its neighbours or has just one.
        if not near.where("m < u AND n > 1").limit(1).count():
            return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        # large-star: a node's larger neighbours go to the least of its neighbours and itself.
        heads = near.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        down = _checked(own.join(heads, "v").select("u", F.col("m").alias("v")).distinct())
        # small-star: a node and its smaller neighbours go to the least of those.
        least = _checked(down.groupBy("u").agg(F.min("v").alias("m")))
        own = _checked(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def merged_components(known: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """The components of `known` (node, component), further joined by edges; only the components that edges touch are worked on."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    touched = connected_components(ends.select(F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")), "x", "y")
    touched = _checked(touched)
    grown = known.join(touched.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    return grown.select("node", F.coalesce("now", "component").alias("component")).unionByName(touched.join(known.select("node"), "node", "left_anti"))


def _checked(df: DataFrame) -> DataFrame:
    return materialize(df, "edges")
