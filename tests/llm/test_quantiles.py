import random

import pytest

from sieveline.llm import quantiles as Q
from sieveline.llm.common import materialize


def hist(spark, groups):
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    return materialize(Q.histogram(spark.createDataFrame(rows, "g string, x long").where("g IS NOT NULL AND x IS NOT NULL"), ["g"]), "values")


def ranks(xs, x):
    return sum(v < x for v in xs), sum(v <= x for v in xs)


def groups():
    draw = random.Random(3)
    return {
        "one": [7], "same": [-5] * 90, "two": [1] * 50 + [2], "few": [3, 1, 2, 2, 9], "wide": [draw.randint(-(10**12), 10**12) for _ in range(500)], "ties": [draw.choice([0, 0, 0, 1, 5, 100]) for _ in range(400)],
        "many": [draw.randint(0, 100_000) for _ in range(6_000)], "lump": [draw.randint(0, 50) if i % 3 else draw.randint(0, 10**9) for i in range(5_000)],
    }


def test_cuts_are_exact(spark):
    """Groups of one value, of ties, of a wide range and of more values than one row may gather."""
    given = groups()
    found = {r.g: r for r in Q.summarise(hist(spark, given), ["g"]).collect()}
    assert set(found) == set(given)
    for g, xs in given.items():
        n, every = len(xs), sorted(xs)
        m = min(n, Q.CUTS)
        values = sorted(set(xs))
        want = sorted({every[-(-j * n // m) - 1] for j in range(1, m + 1)} | {*values[:2], *values[-2:]})
        assert found[g].n == n
        assert [p.x for p in found[g].points] == want
        for p in found[g].points:
            assert (p.below_lo, p.upto_lo) == (p.below_hi, p.upto_hi) == ranks(xs, p.x)


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_bounds_hold(spark, seed):
    """Bounds of merged summaries hold every true rank, also when merged ones are merged again; answers are within 1.5 / CUTS of the rows."""
    draw = random.Random(seed)
    parts = {f"{k}/{b}": [draw.randint(b * 50, 300 + 700 * b) if k else draw.choice([1, 2, 3, b]) for _ in range(draw.choice([3, 30, 400]))] for k in range(2) for b in range(6)}
    summaries = Q.summarise(hist(spark, parts), ["g"]).selectExpr("split(g, '/')[0] AS k", "split(g, '/')[1] AS b", "n", "points")
    at_once = Q.merge(summaries, ["k"])
    twice = Q.merge(Q.merge(summaries.selectExpr("k", "int(b) % 2 AS half", "n", "points"), ["k", "half"]), ["k"])
    for merged in (at_once, twice):
        for r in merged.collect():
            xs = sorted(x for name, own in parts.items() if name[0] == r.k for x in own)
            assert r.n == len(xs) and [p.x for p in r.points] == sorted({p.x for p in r.points})
            for p in r.points:
                below, upto = ranks(xs, p.x)
                assert p.below_lo <= below <= p.below_hi and p.upto_lo <= upto <= p.upto_hi
    for r in Q.answers(at_once, ["k"], 10).collect():
        xs = [x for name, own in parts.items() if name[0] == r.k for x in own]
        below, upto = ranks(xs, r.answer)
        assert max(0, below + 1 - r.target, r.target - upto) <= 1.5 / Q.CUTS * len(xs) + 1


def test_measured(spark):
    given = groups()
    own = hist(spark, given)
    asked = Q.answers(Q.summarise(own, ["g"]), ["g"], 4)
    for r in Q.measured(own, asked, ["g"]).collect():
        xs = given[r.g]
        assert r.exact_x == sorted(xs)[r.target - 1] and (r.n_below, r.n_upto) == ranks(xs, r.answer)


def test_odd_rows(spark):
    """Null keys and values, an empty table, clicks without an id, of no finite value, that come again."""
    assert Q.summarise(hist(spark, {}), ["g"]).count() == 0
    nan, inf = float("nan"), float("inf")
    clicks = spark.createDataFrame([(1, "a", 5, 1.0, 1), (1, "a", 5, 1.0, 1), (2, "b", 5, nan, 1), (3, "b", 5, inf, 1), (4, "b", None, 1.0, 1), (5, "b", 5, None, 1), (None, "b", 5, 2.0, 1)], "click_id long, arrived_at string, client_id long, value double, x int")
    found = sorted(tuple(r) for r in Q.values_of(clicks).collect())
    assert found == [("5", 0, "value", 200, 1), ("5", 7, "value", 7100, 1)]
    # Of rows of an id that differ the first by arrival counts, nulls before others.
    differ = spark.createDataFrame([(1, "b", 5, 1.0), (1, "a", 6, 2.0), (2, "a", 7, 3.0), (2, None, None, 4.0), (3, "a", 8, 1.0), (3, "a", 8, None), (None, "b", 9, 1.0), (None, "a", 9, 3.0)], "click_id long, arrived_at string, client_id long, value double")
    assert sorted((r.grp, r.x % 1000) for r in Q.values_of(differ).collect()) == [("6", 200), ("9", 300)]
    lines = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 1), (3, None)], "item_id long, vendor_id long")
    items = spark.createDataFrame([(1, "b", 1.005), (2, None, 1.0), (3, "b", 0.0)], "item_id long, brand string, price double")
    assert sorted(tuple(r) for r in Q.prices_of(lines, items).collect()) == [("b", 0, "price", 0, 1), ("b", 7, "price", 7100, 2)]
