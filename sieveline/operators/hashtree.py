"""Trees of digests over numbered leaves, built level by level: a node is the SHA-256 of its children's hex digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.sources.scratch import written


def _above(fanout: int) -> Column:
    return F.floor(F.col("pos") / fanout).cast("long")


def joined_digest(children) -> Column:
    """The digest of children, an array of structs whose first field is the position."""
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda x: x["digest"]), ""), 256)


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes(grp, pos, digest, n) -> the level above them: no row holds more than fanout digests."""
    children = F.collect_list(F.struct("pos", "digest"))
    return nodes.groupBy("grp", _above(fanout).alias("pos")).agg(joined_digest(children).alias("digest"), F.ceil(F.first("n") / fanout).cast("long").alias("n")).select("grp", "pos", "digest", "n")


def grow(leaves: DataFrame, fanout: int, label: str = "tree") -> list[DataFrame]:
    """leaves(grp, pos, digest, n) -> the written levels, leaves first.

    grp is never null; pos are numbers from 0 of a group, each at most once, gaps allowed; n is the group's last pos + 1. A level has the nodes of all groups that had
    several nodes below; the node of a level whose n is 1 is its group's root. Each level has a fanout-th of the rows of the one below.
    """
    levels = [written(leaves.select("grp", "pos", "digest", "n"), label)]
    while levels[-1].where("n > 1").limit(1).count():
        levels.append(written(parents(levels[-1].where("n > 1"), fanout), label))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """grp, digest: one row for each group."""
    total = levels[0]
    for level in levels[1:]:
        total = total.unionByName(level)
    return total.where("n = 1").select("grp", "digest")


def rehash(levels: list[DataFrame], changed: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes that other digests of some leaves change, level by level: changed(grp, pos, digest, n) are known leaves. Only their ancestors and
    those ancestors' children are read again."""
    out = [changed.select("grp", "pos", "digest", "n")]
    for level in levels[:-1]:
        asked = out[-1].where("n > 1").select("grp", _above(fanout).alias("up")).distinct()
        same = level.withColumn("up", _above(fanout)).join(asked, ["grp", "up"], "left_semi").drop("up").join(out[-1].select("grp", "pos"), ["grp", "pos"], "left_anti")
        out.append(written(parents(same.unionByName(out[-1].where("n > 1")), fanout), "rehashed"))
    return out
