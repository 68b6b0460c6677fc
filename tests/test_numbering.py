import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import hashtree
from sieveline.operators.numbering import numbered


@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_are_those_of_a_sort(spark, seed):
    """A group with most of the rows, a null group, null keys, and rows that are the same in all of them."""
    draw = random.Random(seed)
    rows = [(draw.choice(["hot"] * 9 + ["a", "b", None]), draw.choice([None, *range(40)]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, k int, id long").repartition(7)
    found = numbered(df, ["k", F.col("id").desc()], ["g"], "n", total="size").collect()
    groups = {}
    for g, k, i in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, -i))
    want = {(g, -x[2]): (n, len(own)) for g, own in groups.items() for n, x in enumerate(sorted(own))}
    assert {(r.g, r.id): (r.n, r["size"]) for r in found} == want
    same = numbered(spark.range(500).select(F.lit("x").alias("g"), F.lit(None).cast("int").alias("k")), ["k"], ["g"])
    assert sorted(r.nth for r in same.collect()) == list(range(500))
    assert numbered(df.limit(0), ["k"]).count() == 0


def plain_root(digests, fanout):
    if not digests:
        return None
    n, nodes = max(digests) + 1, digests
    while n > 1:
        up = {}
        for pos in sorted(nodes):
            up.setdefault(pos // fanout, []).append(nodes[pos])
        nodes, n = {p: hashlib.sha256("".join(own).encode()).hexdigest() for p, own in up.items()}, -(-n // fanout)
    return nodes[0]


def leaves(spark, digests):
    return spark.createDataFrame([("", p, d, max(digests) + 1) for p, d in digests.items()], "grp string, pos long, digest string, n long")


@pytest.mark.parametrize(("places", "fanout"), [([0], 3), (range(9), 3), (range(10), 3), ([0, 1, 5, 40, 41, 200], 4)])
def test_tree_of_digests(spark, places, fanout):
    digests = {p: hashlib.sha256(str(p).encode()).hexdigest() for p in places}
    levels = hashtree.grow(leaves(spark, digests), fanout)
    assert hashtree.roots(levels).first()["digest"] == plain_root(digests, fanout)
    # One changed leaf: one node of each level is hashed again, and it is what a new tree would have.
    changed = digests | {places[-1]: hashlib.sha256(b"new").hexdigest()}
    again = hashtree.rehash(levels, leaves(spark, changed).where(F.col("pos") == places[-1]), fanout)
    assert len(again) == len(levels) and all(level.count() == 1 for level in again)
    assert again[-1].first()["digest"] == plain_root(changed, fanout)
