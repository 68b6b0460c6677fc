"""Mergeable quantile summaries by simultaneous bisection.

A summary holds cut values with bounds of the rows below and up to each. The cut values of a batch are searched for all at once by bisecting the range of values:
a pass counts exactly how many rows lie in each part of the ranges that still hold a cut, which decides several halvings of all cuts. Nothing is sorted. A range with few
distinct values is finished where it is gathered, by the same counting; the size of a group doesn't matter, as counts are combined before they move.

Summaries are merged by adding up bounds: a cut of one summary lies between two cuts of another, whose ranks bound it there.

Rows whose key or value is null are not summarised; ties are counted, never broken; an empty table gives an empty result; other columns are not read. Values are whole
numbers (long): scale others before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import _bound_batches, materialize, table

#: Cuts of a batch by rank. A merged answer is off by 1.5 / CUTS of the rows at most: half of the summed bounds, and one step between neighbouring cuts.
CUTS = 40
#: Halvings that one counting pass decides.
BITS = 6
#: Distinct values of a range that one row may gather.
GATHERED = 2_048
#: Comparisons of a worker's pass that are in memory at once.
PAIRS = 1_000_000
#: What a cut looks for: a number of rows, a number of distinct values, or a value that occurs.
ROWS, DISTINCT, VALUE = 0, 1, 2

_CUT = "array<struct<kind int, id int, wanted long>>"
_POINTS = "array<struct<x long, below_lo long, below_hi long, upto_lo long, upto_hi long>>"
_FOUND = "array<struct<kind int, id int, x long, below long, upto long>>"


def histogram(rows: DataFrame, keys: Sequence[str], x: str = "x", count: str | None = None) -> DataFrame:
    """keys, x, c: how often each value occurs."""
    return rows.groupBy(*keys, x).agg((F.count("*") if count is None else F.sum(count)).alias("c"))


def sizes(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n (rows), d (distinct values)."""
    return hist.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("d"))


def select(hist: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """hist(keys, x, c), written; asked(keys, n, d, cuts) -> keys, found: for each cut its value and the numbers of rows below it and up to it.

    Open ranges (keys, prefix of x, rows below, cuts) shrink by BITS bits a pass; those with few distinct values are gathered and finished.
    """
    keys = list(keys)
    # At first a range is a whole group; the values of those that are too large for one row set what is halved.
    base, shift = 0, None
    asked = asked.where(F.size("cuts") > 0).select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.col("d"), "cuts")
    open_, done = materialize(asked, "ranges"), None
    left = hist
    while True:
        few = open_.where(F.col("d") <= GATHERED).drop("d")
        at = F.lit(0).cast("long") if shift is None else F.shiftright(F.col("x") - base, shift)
        # Merge joins: the ranges grow with the number of groups, so they are never broadcast; a key of many rows can be split there.
        ready = left.withColumn("prefix", at).join(few.hint("merge"), [*keys, "prefix"])
        lists = ready.groupBy(*keys, "prefix").agg(F.collect_list("x").alias("xs"), F.collect_list("c").alias("cs"), F.first("below").alias("below"), F.first("cuts").alias("cuts"))
        found = _finished(lists, keys)
        done = found if done is None else done.unionByName(found)
        rest = open_.where(F.col("d") > GATHERED)
        if shift == 0 or not rest.limit(1).count():
            return done
        left = materialize(left.join(rest.select(*keys).distinct().hint("merge"), keys, "left_semi"), "values")
        if shift is None:
            ends = left.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()  # two numbers
            base, shift = (ends["a"] or 0, ((ends["b"] or 0) - (ends["a"] or 0)).bit_length())
        step = min(BITS, shift)
        shift -= step
        open_ = materialize(_narrowed(left, rest, keys, base, shift, step), "ranges")


def _narrowed(values: DataFrame, ranges: DataFrame, keys: list[str], base: int, shift: int, step: int) -> DataFrame:
    """A counting pass: the parts of the ranges that hold cuts, each with its own ones."""
    part = F.shiftright(F.col("x") - base, shift)
    counts = values.groupBy(*keys, part.alias("part")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    parts = counts.groupBy(*keys, F.shiftright("part", step).alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("part", "n", "d"))).alias("parts"))  # 2 ** step at most
    sums = F.transform("parts", lambda p, i: F.struct(p["part"].alias("part"), p["n"].alias("n"), p["d"].alias("d"), _sum(F.slice("parts", F.lit(1), i), "n").alias("n0"), _sum(F.slice("parts", F.lit(1), i), "d").alias("d0")))
    each = ranges.drop("d").join(parts.hint("merge"), [*keys, "prefix"]).select(*keys, "below", "cuts", F.explode(sums).alias("p"))
    wanted = lambda c: c["wanted"]
    by_rank = lambda c, before, size: (wanted(c) > before) & (wanted(c) <= before + size)
    within = F.filter("cuts", lambda c: F.when(c["kind"] == ROWS, by_rank(c, F.col("p.n0"), F.col("p.n"))).when(c["kind"] == DISTINCT, by_rank(c, F.col("p.d0"), F.col("p.d"))).otherwise(F.shiftright(wanted(c) - base, shift) == F.col("p.part")))
    less = lambda c: F.when(c["kind"] == ROWS, wanted(c) - F.col("p.n0")).when(c["kind"] == DISTINCT, wanted(c) - F.col("p.d0")).otherwise(wanted(c))
    moved = F.transform(within, lambda c: F.struct(c["kind"].alias("kind"), c["id"].alias("id"), less(c).alias("wanted")))
    return each.select(*keys, F.col("p.part").alias("prefix"), (F.col("below") + F.col("p.n0")).alias("below"), F.col("p.d").alias("d"), moved.alias("cuts")).where(F.size("cuts") > 0)


def _sum(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda total, r: total + r[field])


def _finished(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Bisects the gathered ranges: keys, below, xs, cs, cuts -> keys, found."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType.simpleString() for f in lists.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", found {_FOUND}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = np.cumsum(_lengths(batch.column("xs")) * _lengths(batch.column("cuts")))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + PAIRS, "right")))
                own = batch.slice(begin, end - begin)
                found = _bisected(own).cast(arrow.field("found").type)
                yield pa.RecordBatch.from_arrays([*(own.column(k).cast(arrow.field(k).type) for k in keys), found], schema=arrow)
                begin = end

    _bound_batches(lists.sparkSession)
    return lists.select(*keys, "below", "xs", "cs", "cuts").mapInArrow(run, schema)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _bisected(batch: pa.RecordBatch) -> pa.Array:
    """All cuts of all rows of a batch at once: each pass counts the values up to the middle of every cut's range."""
    xs, cs, cuts = (batch.column(c) for c in ("xs", "cs", "cuts"))
    x, c = xs.flatten().to_numpy(zero_copy_only=False), cs.flatten().to_numpy(zero_copy_only=False)
    kind, name, wanted = (a.to_numpy(zero_copy_only=False) for a in cuts.flatten().flatten())
    values, asked = _lengths(xs), _lengths(cuts)
    row = np.repeat(np.arange(len(asked)), asked)
    starts = np.concatenate(([0], np.cumsum(values)[:-1]))
    per_cut = values[row]
    first = np.concatenate(([0], np.cumsum(per_cut)[:-1]))
    cut = np.repeat(np.arange(len(row)), per_cut)
    pair = starts[row][cut] + np.arange(len(cut)) - first[cut]
    x, c = x[pair], c[pair]
    weight = np.where(kind[cut] == DISTINCT, 1, c)
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    low, high = np.where(kind == VALUE, wanted, low), np.where(kind == VALUE, wanted, high)
    while (low < high).any():
        middle = low + (high - low) // 2
        enough = np.add.reduceat(np.where(x <= middle[cut], weight, 0), first) >= wanted
        low, high = np.where(enough | (low >= high), low, middle + 1), np.where(enough, middle, high)
    below = np.add.reduceat(np.where(x < low[cut], c, 0), first) + batch.column("below").to_numpy()[row]
    upto = below + np.add.reduceat(np.where(x == low[cut], c, 0), first)
    found = pa.StructArray.from_arrays([pa.array(a) for a in (kind, name, low, below, upto)], ["kind", "id", "x", "below", "upto"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(asked))).astype(np.int32)), found)


def summarise(hist: DataFrame, keys: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """keys, n, points: the summary of each group of hist(keys, x, c), a written table. Cut j of `cuts` is the value of the ceil(j * n / cuts)-th row; the two least and the two greatest
    values are cuts too. A point has bounds of the rows below and up to it, here exact: x, below_lo, below_hi, upto_lo, upto_hi."""
    keys = list(keys)
    size = sizes(hist, keys)

    def make(batch: pa.RecordBatch) -> dict:
        n, d = (batch.column(c).to_numpy() for c in ("n", "d"))
        m = np.minimum(n, cuts)
        total = m + np.minimum(d, 4)
        row = np.repeat(np.arange(len(n)), total)
        at = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        own = m[row]
        by_rows = at < own
        # The first two and the last two of the distinct values; all where there are no more than four.
        end = at - own + 1
        end = np.where((end > 2) & (d[row] > 4), d[row] - 4 + end, end)
        wanted = np.where(by_rows, ((at + 1) * n[row] + own - 1) // own, end)
        found = pa.StructArray.from_arrays([pa.array(np.where(by_rows, ROWS, DISTINCT).astype(np.int32)), pa.array(np.zeros(len(row), np.int32)), pa.array(wanted)], ["kind", "id", "wanted"])
        return {"n": n, "d": d, "cuts": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(total))).astype(np.int32)), found)}

    asked = _by_batch(size, keys, ["n", "d"], f"n long, d long, cuts {_CUT}", make)
    point = lambda p: F.struct(p["x"].alias("x"), p["below"].alias("below_lo"), p["below"].alias("below_hi"), p["upto"].alias("upto_lo"), p["upto"].alias("upto_hi"))
    found = select(hist, asked, keys).select(*keys, F.transform("found", point).alias("points"))
    # A group has a row for each range with cuts, most have one.
    parts = found.groupBy(*keys).agg(F.collect_list("points").alias("p"))
    whole = parts.select(*keys, F.array_sort(F.array_distinct(F.flatten("p"))).alias("points"))
    return whole.select(*keys, F.element_at("points", -1)["upto_hi"].alias("n"), "points")


def merge(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, points of the summaries of each group together: all their cuts, with the sums of the bounds that each summary has there. summaries(keys, n, points) may be
    merged ones. A group has few summaries, each of bounded size."""
    keys = list(keys)
    kind = "array<struct<x long, a0 long, a1 long, b1 long, c0 long, d0 long, d1 long>>"
    own = _by_batch(summaries, keys, ["points"], f"s {kind}", _steps).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")
    by_x = own.groupBy(*keys, "x").agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b1", "c0", "d0", "d1")))
    lists = by_x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "a0", "a1", "b1", "c0", "d0", "d1"))).alias("s"))
    return _by_batch(lists, keys, ["s"], f"n long, points {_POINTS}", _merged)


def _steps(batch: pa.RecordBatch) -> dict:
    """How the bounds change at a point and after it; between two points the bounds are those of the one before and of the one after."""
    lists = batch.column("points")
    x, below_lo, below_hi, upto_lo, upto_hi = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
    lengths = _lengths(lists)
    ends = np.cumsum(lengths)
    before, after = np.concatenate(([0], upto_lo[:-1])), np.concatenate((below_hi[1:], [0]))
    before[(ends - lengths)[lengths > 0]] = 0
    last = ends[lengths > 0] - 1
    after[last] = upto_hi[last]
    figures = (x, below_lo - before, upto_lo - below_lo, after - below_hi, upto_lo - before, upto_hi - below_hi, after - upto_hi)
    steps = pa.StructArray.from_arrays([pa.array(a) for a in figures], ["x", "a0", "a1", "b1", "c0", "d0", "d1"])
    return {"s": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), steps)}


def _merged(batch: pa.RecordBatch) -> dict:
    """The bounds at each cut as running sums of their changes within a row."""
    lists = batch.column("s")
    lengths, fields = _lengths(lists), dict(zip(("x", "a0", "a1", "b1", "c0", "d0", "d1"), (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten()), strict=True))
    ends = np.cumsum(lengths)

    def running(name: str) -> np.ndarray:
        total = np.cumsum(fields[name])
        return total - np.repeat(np.concatenate(([0], total))[ends - lengths], lengths)

    below_lo = running("a0") + running("a1") - fields["a1"]
    upto_lo, below_hi = running("c0"), running("b1") - fields["b1"]
    upto_hi = running("d0") + running("d1") - fields["d1"]
    points = pa.StructArray.from_arrays([pa.array(a) for a in (fields["x"], below_lo, below_hi, upto_lo, upto_hi)], ["x", "below_lo", "below_hi", "upto_lo", "upto_hi"])
    return {"n": upto_hi[ends - 1], "points": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), points)}


def _by_batch(rows: DataFrame, keys: list[str], read: list[str], made: str, make) -> DataFrame:
    """mapInArrow that keeps the keys; make(batch) gives the other columns, in the order of `made`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), made])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = {k: batch.column(k) for k in keys} | make(batch)
                yield pa.RecordBatch.from_arrays([(c if isinstance(c := columns[f.name], pa.Array) else pa.array(c)).cast(f.type) for f in arrow], schema=arrow)

    _bound_batches(rows.sparkSession)
    return rows.select(*keys, *read).mapInArrow(run, schema)


def answers(summaries: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """keys, n, points (their number), i, target, answer, below, upto for i of 1 to parts - 1, with target = ceil(i * n / parts): the first cut whose rows, by the middle of
    their bounds, reach the target, with the middle of its bounds."""

    def make(batch: pa.RecordBatch) -> dict:
        lists = batch.column("points")
        x, below_lo, below_hi, upto_lo, upto_hi = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
        lengths, n = _lengths(lists), batch.column("n").to_numpy()
        i = np.tile(np.arange(1, parts), len(n))
        target = (i * np.repeat(n, parts - 1) + parts - 1) // parts
        # Twice the middle of the bounds rises within a row; with what all rows before have it rises throughout.
        before = np.cumsum(2 * n + 1) - (2 * n + 1)
        at = np.searchsorted(upto_lo + upto_hi + np.repeat(before, lengths), 2 * target + np.repeat(before, parts - 1))
        found = pa.StructArray.from_arrays([pa.array(a) for a in (i.astype(np.int32), target, x[at], (below_lo[at] + below_hi[at]) / 2, (upto_lo[at] + upto_hi[at]) / 2)], ["i", "target", "answer", "below", "upto"])
        return {"n": n, "points": lengths.astype(np.int64), "a": pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * (parts - 1)).astype(np.int32)), found)}

    kind = "array<struct<i int, target long, answer long, below double, upto double>>"
    found = _by_batch(summaries, list(keys), ["n", "points"], f"n long, points long, a {kind}", make)
    return found.select(*keys, "n", "points", F.explode("a").alias("a")).select(*keys, "n", "points", "a.*")


def measured(hist: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """given(keys, n, i, target, answer) -> with exact_x, n_below, n_upto: the target-th smallest value of hist(keys, x, c), a written table in which a
    value may be in several rows of a group (fewer than GATHERED), and the rows below and up to the answer, by the same counting passes."""
    keys = list(keys)
    # No group has more distinct values than rows.
    asked = given.groupBy(*keys).agg(F.first("n").alias("d"), F.flatten(F.collect_list(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col("i").alias("id"), F.col(c).alias("wanted")) for kind, c in ((ROWS, "target"), (VALUE, "answer")))))).cast(_CUT).alias("cuts"))
    found = select(hist, asked, keys).select(*keys, F.explode("found").alias("f")).select(*keys, F.col("f.kind").alias("kind"), F.col("f.id").alias("i"), "f.x", "f.below", "f.upto")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    by_cut = found.groupBy(*keys, "i").agg(pick(ROWS, "x").alias("exact_x"), pick(VALUE, "below").alias("n_below"), pick(VALUE, "upto").alias("n_upto"))
    return given.join(by_cut.hint("merge"), [*keys, "i"])


BATCHES = 8
#: The group first: sorts compare it first.
KEYS = ["grp", "batch", "stream"]


def _batch(key: str) -> Column:
    """Rows without an id are batch 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % BATCHES, F.lit(0)).cast("int")


def _scaled(money: str) -> Column:
    return (F.floor(100 * F.col(money) + 0.5) + 1_000 * F.col("batch")).cast("long")


def _finite(money: str) -> Column:
    return F.col(money).isNotNull() & ~F.isnan(money) & (F.abs(money) < float("inf"))


def values_of(clicks: DataFrame) -> DataFrame:
    """stream, grp, batch, x, c of clicks, each click_id once (the first of its rows by arrived_at, client_id and value)."""
    figures = [f(c).alias(f"{name}_{c}") for c in ("client_id", "value") for name, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    # Rows of an id that are the same in client and value, as nearly all are, need no order, so no sort.
    found = materialize(clicks.groupBy("click_id").agg(F.count("*").alias("n"), *figures), "clicks")
    alike = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) & F.col(f"n_{c}").isin(F.lit(0), F.col("n")) for c in ("client_id", "value")]
    own = found.where(alike[0] & alike[1]).select("click_id", F.col("a_client_id").alias("client_id"), F.col("a_value").alias("value"))
    other = found.where(~(alike[0] & alike[1])).select("click_id", F.lit(True).alias("other"))
    if other.limit(1).count():
        again = clicks.withColumn("_id", F.struct("click_id")).join(other.select(F.struct("click_id").alias("_id")).hint("merge"), "_id", "left_semi")
        first = again.groupBy("click_id").agg(F.min(F.struct("arrived_at", "client_id", "value")).alias("r")).select("click_id", "r.client_id", "r.value")
        own = own.unionByName(first)
    own = own.where(F.col("client_id").isNotNull() & _finite("value"))
    own = own.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), _batch("click_id").alias("batch"), "value")
    return histogram(own.withColumn("x", _scaled("value")), KEYS)


def prices_of(sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, x, c of sale lines with their items. Lines are counted by item and batch before they meet the items."""
    lines = sale_lines.where("item_id IS NOT NULL").groupBy("item_id", _batch("vendor_id").alias("batch")).agg(F.count("*").alias("c"))
    priced = items.where(F.col("brand").isNotNull() & _finite("price")).select("item_id", "brand", "price")
    own = lines.join(priced.hint("merge"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", "c", "price")
    return histogram(own.withColumn("x", _scaled("price")), KEYS, count="c")


def deciles(spark: SparkSession, sf_dir: str, parts: int = 10, least: int = 20, allowed: float = 0.05) -> DataFrame:
    """The deciles of both streams by the summaries of each batch of each group and by their merged ones (batch -1), held against the exact ones."""
    # Joins leave their rows sorted by group: gathering them then needs no hash table and no other sort.
    setting = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        return _deciles(spark, sf_dir, parts, least, allowed)
    finally:
        spark.conf.set(setting, before)


def _deciles(spark: SparkSession, sf_dir: str, parts: int, least: int, allowed: float) -> DataFrame:
    hist = values_of(table(spark, sf_dir, "clicks")).unionByName(prices_of(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items")))
    hist = materialize(hist, "values")
    batches = materialize(summarise(hist, KEYS), "summaries")
    whole = merge(batches, ["grp", "stream"]).withColumn("batch", F.lit(-1))
    asked = F.col("n") >= least
    # The exact figures of a batch are in its own summary: its deciles are cuts, and the bounds of its cuts are exact.
    own = answers(batches.where(asked), KEYS, parts).withColumns({"exact_x": F.col("answer"), "n_below": F.col("below").cast("long"), "n_upto": F.col("upto").cast("long")})
    merged = materialize(answers(whole.where(asked), KEYS, parts), "answers")
    merged = measured(hist.withColumn("batch", F.lit(-1)), merged, KEYS)
    columns = [*KEYS, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto"]
    every = own.select(*columns).unionByName(merged.select(*columns))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    every = materialize(every, "deciles")
    return every.withColumn("rank_error", error).withColumn("within", 1_000 * F.col("rank_error") <= round(1_000 * allowed) * F.col("n"))
