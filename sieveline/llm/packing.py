"""Best-fit decreasing packing of whole documents into sequences of a fixed token capacity.

The number of distinct lengths is bounded by the capacity, so best-fit decreasing over the whole corpus needs only how often each
length occurs. `best_fit_decreasing` runs it on these counts: bins that look alike are one run of bins, and a segment tree over the
remaining capacities finds the tightest open ones in logarithmic time. What comes out says, for each length, which rank
(first, second, ... piece of that length) goes to which bin and offset. The pieces' ranks are counted in parallel:
by partition while tokenizing, then by prefix sums over the partitions' counts.

Nulls are empty texts; an empty text still has its end token. Repeated rows are packed as often as they come. A null doc_id stays null.
An empty table gives an empty result, and other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from itertools import count as counting

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.bpe import broadcast_bpe, worker_bpe
from sieveline.llm.common import map_rows, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


class CapacityTree:
    """How many runs of bins there are for each remaining capacity; finds the least one that holds a length."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.has = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.leaves
        while at:
            self.has[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of length or more that an open bin has."""
        at = length + self.leaves
        if self.has[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.has[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, lo, hi, first, per_bin, offset), and the number of bins.

    Pieces of that length with ranks lo..hi-1 go, per_bin at a time, into bins first, first+1, ..., there from offset on.
    Just what best-fit decreasing does piece by piece: a bin that took one piece and holds another is then the tightest for it.
    """
    tree, open_runs, slots, bins = CapacityTree(capacity), {}, [], 0

    def put(first: int, n: int, remaining: int) -> None:
        if n and remaining:
            open_runs.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                per_bin = capacity // length
                first, n, remaining = bins, -(-left // per_bin), capacity
                bins += n
            else:
                first, n = open_runs[remaining].pop()
                tree.add(remaining, -1)
                per_bin = remaining // length
            full = min(n, left // per_bin)
            if full:
                slots.append((length, rank, rank + full * per_bin, first, per_bin, capacity - remaining))
                put(first, full, remaining - per_bin * length)
                rank, left = rank + full * per_bin, left - full * per_bin
            if left and full < n:  # fewer than fill a bin of this run
                slots.append((length, rank, rank + left, first + full, per_bin, capacity - remaining))
                put(first + full, 1, remaining - left * length)
                full, left = full + 1, 0
            put(first + full, n - full, remaining)
    return slots, bins


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece; part and local number the pieces of a length within a task."""
    sent = broadcast_bpe(docs.sparkSession, tokenizer_path)
    end = end_id.to_bytes(4, "little")

    def make():
        packed, part = worker_bpe(*sent.value).packed, TaskContext.get().partitionId()
        ranks = [counting() for _ in range(capacity + 1)]

        def step(batch):
            doc_ids, pieces, starts, lengths, crcs, local = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = packed(text or "") + end
                n = len(ids) // 4
                start, stop = 0, n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    doc_ids.append(doc_id)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * stop]))
                    local.append(next(ranks[stop - start]))
                    piece, start, stop = piece + 1, stop, stop + capacity
            return {"doc_id": doc_ids, "piece": pieces, "start": starts, "length": lengths, "ids_crc32": crcs, "part": [part] * len(pieces), "local": local}

        return step

    return map_rows(docs, ["doc_id", "text"], make, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs."""
    spark = docs.sparkSession
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots, _ = best_fit_decreasing(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A run of bins is split at most twice by a length, so there are fewer than 4 * capacity slots.
    place = spark.createDataFrame(slots, "length long, lo long, hi long, first long, per_bin long, at long")
    rank = F.col("base") + F.col("local")
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", rank)
    found = ranked.join(F.broadcast(place.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    turn = F.col("rank") - F.col("lo")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(turn / F.col("per_bin"))).cast("long").alias("sequence_id"), (F.col("at") + (turn % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"))
