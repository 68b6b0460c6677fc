"""Running numbers of a sorted table without a window over all of it: two passes over ranges of the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.scratch import written

#: monotonically_increasing_id() has the partition above so many bits and the place in the partition below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "nth", label: str = "numbered", total: str | None = None) -> DataFrame:
    """rows with `name`: the place of each row, from 0, by `order` within its group of `by` (nulls are a group; nulls come first in an order); with `total`, where it is named: the number
    of rows of the group.

    Rows are dealt by ranges of (by, order), so that a group of any size lies on as many partitions as it fills. Each partition counts its own groups;
    the sums of the counts before it give its first number: only
    these counts, a row for each group on a partition, are ever in one window. Rows of the same group and order get numbers in no set order.
    """
    keys = [F.col(c) for c in by]
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    # Rows that are the same in all keys would lie on one partition: a number drawn for each deals them out too.
    spread = rows.withColumn("_spread", F.rand(17))
    dealt = spread.repartitionByRange(*keys, *ordered, F.col("_spread")).sortWithinPartitions(*keys, *ordered).drop("_spread").withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, label).withColumns({"_part": F.shiftright("_at", _PLACE_BITS), "_place": F.col("_at") % (1 << _PLACE_BITS)}).drop("_at")
    # A struct as key: a null in it is a value like any other, for the join too.
    group = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("all"))
    counts = dealt.groupBy(group.alias("_group"), "_part").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_start"), F.sum("n").over(Window.partitionBy("_group")).alias("_total"))
    joined = dealt.join(starts, (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(group))
    joined = joined.withColumns({name: (F.col("_start") + F.col("_place")).cast("long")} | ({total: F.col("_total")} if total else {}))
    return joined.drop("_g", "_p", "_start", "_total", "_part", "_place")
