"""Bloom filters of bounded size, built by the executors: they keep most rows that a join would leave out from being moved."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows

#: Bits of a filter, at least and at most; it is broadcast.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26
#: Places of a value in a filter.
PLACES = ("place0", "place1", "place2")
#: Where a hash's places are in it.
SHIFTS = (0, 20, 38)


def filter_of(values: DataFrame, hashed: bool = False) -> tuple[np.ndarray, int]:
    """The filter of the one column of values as words of 64 bits, and its bits. Its size is bounded, whatever there is in it: when it is full it only lets more pass.

    hashed: the values are hashes already, see `passes`.
    """
    (column,) = values.columns
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * values.count()).bit_length()))
    own = [F.shiftrightunsigned(column, k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS] if hashed else _places(column, size)
    places = values.select(F.explode(F.array(*own)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64), size


def _places(column: str, size: int) -> list:
    return [F.pmod(F.xxhash64(column, F.lit(k)), F.lit(size)) for k in range(len(PLACES))]


def _has(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def passes(ids: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a filter of hashes."""
    words, size = ids
    found = np.ones(len(hashes), bool)
    for k in SHIFTS:
        found &= _has(words, (hashes >> np.uint64(k)) & np.uint64(size - 1))
    return found


def in_filter(rows: DataFrame, column: str, ids: tuple[np.ndarray, int], columns: list[str], schema: str, make, text: str, inside: bool = True) -> DataFrame:
    """make()(batch) of the rows whose column is in the filter `ids`, or of the others: those in it are all that went in and a few more."""
    bits, size = ids
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def filtering():
        step, words = make(), sent.value

        def filtered(batch):
            found = np.ones(batch.num_rows, bool)
            for name in PLACES:
                found &= _has(words, batch.column(name).to_numpy().astype(np.uint64))
            some = batch.filter(pa.array(found == inside))
            return step(some) if some.num_rows else None

        return filtered

    placed = rows.select(*columns, *(p.alias(name) for name, p in zip(PLACES, _places(column, size), strict=True)))
    return map_rows(placed, [*columns, *PLACES], filtering, schema, text=text)


def as_it_is(columns: list[str]):
    """For `make`: the rows' columns as they are."""
    return lambda: lambda batch: {c: batch.column(c) for c in columns}
