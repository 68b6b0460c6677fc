"""A manifest of a table as Merkle trees: a tree for each group of rows, and one over the groups' roots.

Built from the leaves up, each level written; proofs are pushed down from the root: the children of a level are joined to their parents, and each child puts its
siblings in front of the path that it inherits. A path is an array with the digests before and after a node's own at each level, so it both proves and folds.

Columns may be null anywhere (a null is told from an empty text); rows that are the same in every column are leaves of their own, in no set order among
themselves; rows of a group with the same key are ordered by their digests; a null group is one like others and comes first; an empty table has an empty
manifest; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import materialize
from sieveline.operators import hashtree
from sieveline.operators.numbering import numbered

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """A value such that no two rows have the same joined ones: `-` for a null, else its length in bytes, a colon, its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[str] = COLUMNS, **instead: Column) -> Column:
    """The digest of a row; `instead` gives other values for some columns."""
    return F.sha2(F.concat(*(framed(instead.get(c, F.col(c))) for c in columns)), 256)


class Manifest:
    """levels: of the groups' trees (grp, pos, digest, n); top: of the tree over their roots; leaves: the rows' own columns with grp, pos, digest, n."""

    def __init__(self, leaves: DataFrame, levels: list[DataFrame], top: list[DataFrame], order: DataFrame, fanout: int) -> None:
        self.leaves, self.levels, self.top, self.order, self.fanout = leaves, levels, top, order, fanout

    @property
    def root(self) -> DataFrame:
        """One row: root; none for an empty table."""
        return hashtree.roots(self.top).select(F.col("digest").alias("root"))

    def paths(self, *carried: str) -> DataFrame:
        """grp, pos, digest, subroot, path of each leaf, with the carried columns of its row."""
        heads = materialize(_pushed(self.top, self.fanout, None), "heads")
        heads = self.order.join(heads.select("pos", "path"), "pos").select("grp", F.col("digest").alias("subroot"), "path")
        return _pushed([self.leaves, *self.levels[1:]], self.fanout, materialize(heads, "heads"), carried)


def build(rows: DataFrame, digest: Column, group: str, key: str, kept: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of rows with a leaf each, in the order of key within groups; `kept` are columns that stay with the leaves."""
    # A null group is told from all others and comes before them.
    grp = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    # Written first: dealing by ranges reads its input twice, and the texts should be hashed once.
    own = rows.select(grp.alias("grp"), F.col(key).alias("key"), digest.alias("digest"), *(c.alias(name) for name, c in (kept or {}).items()))
    leaves = materialize(numbered(materialize(own, "digests"), ["key", "digest"], ["grp"], "pos", total="n").drop("key"), "leaves")
    levels = hashtree.grow(leaves, fanout)
    subroots = materialize(numbered(hashtree.roots(levels), ["grp"], name="pos", total="n"), "subroots")
    top = hashtree.grow(subroots.withColumn("grp", F.lit("")), fanout)
    return Manifest(leaves, levels, top, subroots, fanout)


def _pushed(levels: list[DataFrame], fanout: int, heads: DataFrame | None, carried: Sequence[str] = ()) -> DataFrame:
    """grp, pos, digest, subroot, path of the nodes of the lowest level. heads(grp, subroot, path): what a group's root inherits; nothing where there are none."""
    nothing = F.array().cast("array<struct<before string, after string>>")

    def at_the_top(level: DataFrame, kept: Sequence[str]) -> DataFrame:
        own = level.where("n = 1").select("grp", "pos", "digest", *kept)
        return own.withColumns({"subroot": F.col("digest"), "path": nothing}) if heads is None else own.join(heads, "grp")

    above = None
    for k in range(len(levels) - 1, -1, -1):
        kept = carried if k == 0 else ()
        own = at_the_top(levels[k], kept).select("grp", "pos", "digest", *kept, "subroot", "path")
        if above is not None:
            up = F.floor(F.col("pos") / fanout).cast("long")
            runs = levels[k].where("n > 1").groupBy("grp", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *kept))).alias("children"))
            runs = runs.join(above.select("grp", F.col("pos").alias("up"), "subroot", "path"), ["grp", "up"])
            each = runs.select("grp", "subroot", "path", F.col("children.digest").alias("digests"), F.posexplode("children").alias("i", "child"))
            siblings = F.struct(F.array_join(F.slice("digests", F.lit(1), F.col("i")), "").alias("before"), F.array_join(F.slice("digests", F.col("i") + 2, F.lit(fanout)), "").alias("after"))
            pushed = each.select("grp", "child.pos", "child.digest", *(f"child.{c}" for c in kept), "subroot", F.concat(F.array(siblings), "path").alias("path"))
            own = own.unionByName(pushed)
        above = own if k == 0 else materialize(own, "paths")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda digest, at: F.sha2(F.concat(at["before"], digest, at["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), ""), 256)


def audit(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of documents: the manifest of the table as it is, against a copy in which A-Z of
    the texts are small letters where 5 divides the crc32 of the id (rows without an id or a text are copied as they are)."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    kept = {"doc_id": F.col("doc_id"), "copied": F.when(tampered, leaf_digest(text=F.translate("text", _UPPER, _LOWER)))}
    manifest = build(docs, leaf_digest(), "source", "doc_id", kept, fanout)
    found = manifest.paths("doc_id", "copied").crossJoin(F.broadcast(manifest.root))  # one row
    found = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("copied", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
