"""Benchmark decontamination: a hash set of the test windows' word n-grams against every window of the training words.

Words are runs of ASCII letters or digits and of any non-ASCII characters, A-Z in lower case. A window is `n` consecutive words of an
item, or all words of a shorter one. The hashes of a benchmark of up to `block_bytes` go to the executors as sorted arrays, about 40 bytes a word;
all windows of a batch of documents are looked up by rolling hash and each hit is verified by its words' bytes.

A larger benchmark stays a table: a filter of bounded size goes out instead, the documents' windows in it are joined with the benchmark's by hash and
words, and the hits meet by row. The documents are read a fixed number of times, however large the benchmark is.

Null texts have no words. An item without words has no window. Repeated rows are judged each; items with the same
id count once, those without an id are hit but not counted. A null doc_id stays null, an empty table gives an empty result, an empty benchmark leaves all clean. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import DOCUMENT, Remembered, keep_batches, map_rows, materialize
from sieveline.llm.filters import filter_of, passes
from sieveline.llm.words import LETTERS_AND_DIGITS, Words, words_in

#: Bytes of item texts up to which the windows are sent to the executors.
BLOCK_BYTES = 16_000_000
#: Entries of the table of hash beginnings that most windows of documents are turned away by.
BEGINNINGS = 1 << 22
#: Windows whose items are remembered.
KNOWN = 10_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of `size` consecutive words."""
    total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        total *= _MULTIPLIER
        total += hashes[k : len(hashes) - size + 1 + k]
    total ^= total >> np.uint64(29)
    return total * _MULTIPLIER


def _own_windows(words: Words, n: int) -> dict[int, np.ndarray]:
    """The first words of the items' windows, by size."""
    counts, found = np.diff(words.at), {}
    for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
        some = np.flatnonzero(counts >= n if size == n else counts == size)
        times = counts[some] - size + 1
        found[size] = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(words.at[:-1][some], times)
    return found


class Windows:
    """The windows of all items as sorted hashes, with the words to verify hits."""

    def __init__(self, ids: list[str | None], texts: pa.Array, n: int) -> None:
        own = words_in(texts, LETTERS_AND_DIGITS)
        self.ids = ids
        self.words = own._replace(starts=own.starts.astype(np.int32), ends=own.ends.astype(np.int32), hashes=None)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.begin = np.zeros(BEGINNINGS, bool)
        for size, first in _own_windows(own, n).items():
            hashes = rolled(own.hashes, size)[first]
            order = np.argsort(hashes, kind="stable")
            self.tables[size] = hashes[order], first[order].astype(np.int32)
            self.begin[self._beginning(hashes)] = True
        self.known = Remembered(lambda key: self._items(*key), KNOWN)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = Remembered(lambda key: self._items(*key), KNOWN)

    @staticmethod
    def _beginning(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - BEGINNINGS.bit_length() + 1)).astype(np.int64)

    def _items(self, size: int, a: int, b: int) -> dict[bytes, list[int]]:
        """The items of each window that has the hash of places a..b-1."""
        found: dict[bytes, set[int]] = {}
        first = self.tables[size][1][a:b]
        for p, item in zip(first.tolist(), (np.searchsorted(self.words.at, first, "right") - 1).tolist(), strict=True):
            found.setdefault(self.words.said(p, size), set()).add(item)
        return {said: sorted(items) for said, items in found.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, number of words, items) of each window in a batch of documents."""
        text = words.text_of()
        for size, (hashes, _) in self.tables.items():
            if len(text) < size:
                continue
            own = rolled(words.hashes, size)
            near = np.flatnonzero((text[: len(own)] == text[size - 1 :]) & self.begin[self._beginning(own)])
            a, b = np.searchsorted(hashes, own[near], "left"), np.searchsorted(hashes, own[near], "right")
            some = b > a
            for at, x, y in zip(near[some].tolist(), a[some].tolist(), b[some].tolist(), strict=True):
                items = self.known[size, x, y].get(words.said(at, size))
                if items is not None:
                    yield at, size, items

    def judged(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """For each word of a batch whether it is hit, and each text's items."""
        change = np.zeros(len(words.hashes) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(len(words.at) - 1)]
        for at, size, own in self.hits(words):
            change[at] += 1
            change[at + size] -= 1
            items[int(np.searchsorted(words.at, at, "right")) - 1].update(own)
        return np.cumsum(change[:-1]) > 0, items


def _hit_counts(words: Words, hit: np.ndarray) -> np.ndarray:
    ahead = np.concatenate(([0], np.cumsum(hit)))
    return ahead[words.at[1:]] - ahead[words.at[:-1]]


def _digest(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _sent_windows(benchmark: DataFrame, n: int, block_bytes: int):
    """The windows as a broadcast, or None where the benchmark is larger than that."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if size["b"] + 64 * size["n"] > block_bytes:
        return None
    own = items.toArrow().combine_chunks()
    texts = own.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return benchmark.sparkSession.sparkContext.broadcast(Windows(own.column("item_id").to_pylist(), texts, n))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs. The passages of items without an item_id count
    in n_hit, and so for contaminated, but not as items."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    sent = _sent_windows(benchmark, n, block_bytes)
    if sent is None:
        return _judged_by_tables(docs, _hits_by_tables(docs, benchmark, n))

    def make():
        windows = sent.value

        def step(batch):
            words = words_in(batch.column("text"), LETTERS_AND_DIGITS)
            hit, items = windows.judged(words)
            n_words, n_hit = np.diff(words.at), _hit_counts(words, hit)
            named = [{x for i in own if (x := windows.ids[i]) is not None} for own in items]
            return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_hit": n_hit, "n_items": [len(x) for x in named], "items_sha256": [_digest(x) for x in named], "contaminated": (n_hit > 0) & (20 * n_hit >= n_words)}

        return step

    return map_rows(docs, ["doc_id", "text"], make, schema)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of documents."""
    sent = _sent_windows(benchmark, n, block_bytes)
    if sent is None:
        # Texts that are equal are judged alike, so a text's own hash is its id.
        own = _hashed_texts(docs)
        bad = _judged_by_tables(own, _hits_by_tables(own, benchmark, n)).where("contaminated").select(F.col("doc_id").alias("bad_text"))
        columns = ["doc_id", "text", "lang", "source", "n_chars"]
        return docs.select(columns).withColumn("text_hash", F.xxhash64("text")).join(bad, F.col("text_hash") == F.col("bad_text"), "left_anti").select(columns)

    def make():
        windows = sent.value

        def keeps(batch):
            words = words_in(batch.column("text"), LETTERS_AND_DIGITS)
            n_hit = _hit_counts(words, windows.judged(words)[0])
            return (n_hit == 0) | (20 * n_hit < np.diff(words.at))

        return keeps

    return keep_batches(docs, make)


def without_passages(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs with each stretch of words that are hit cut out of the text, with the columns of documents; n_chars is the new text's."""
    sent = _sent_windows(benchmark, n, block_bytes)
    columns = ["doc_id", "text", "lang", "source"]

    def result(batch, words, hit):
        texts = _cut(batch.column("text"), words, hit)
        return {c: batch.column(c) for c in ("doc_id", "lang", "source")} | {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}

    if sent is not None:

        def make():
            def step(batch):
                words = words_in(batch.column("text"), LETTERS_AND_DIGITS)
                return result(batch, words, sent.value.judged(words)[0])

            return step

        return map_rows(docs, columns, make, DOCUMENT)
    hits = _hits_by_tables(_hashed_texts(docs), benchmark, n).groupBy(F.col("doc_id").alias("hit_text")).agg(F.collect_set(F.struct("at", "size")).alias("hits"))
    joined = docs.select(columns).withColumn("text_hash", F.xxhash64("text")).join(hits, F.col("text_hash") == F.col("hit_text"), "left").select(*columns, "hits.at", "hits.size")

    def make_joined():
        def step(batch):
            words = words_in(batch.column("text"), LETTERS_AND_DIGITS)
            change = np.zeros(len(words.hashes) + 1, np.int64)
            for first, at, size in zip(words.at[:-1].tolist(), batch.column("at").to_pylist(), batch.column("size").to_pylist(), strict=True):
                for a, k in zip(at or (), size or (), strict=True):
                    change[first + a] += 1
                    change[first + a + k] -= 1
            return result(batch, words, np.cumsum(change[:-1]) > 0)

        return step

    return map_rows(joined, [*columns, "at", "size"], make_joined, DOCUMENT)


def _cut(column: pa.Array, words: Words, hit: np.ndarray) -> list[str | None]:
    ahead = np.concatenate(([0], np.cumsum(hit)))
    texts = column.to_pylist()
    place = 0
    for i, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)):
        raw = (texts[i] or "").encode()
        if ahead[b] > ahead[a]:
            edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).astype(np.int8))) + a
            out, at = [], 0
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out.append(raw[at : int(words.starts[x]) - place])
                at = int(words.ends[y - 1]) - place
            texts[i] = b"".join([*out, raw[at:]]).decode()
        place += len(raw)
    return texts


def _hashed_texts(docs: DataFrame) -> DataFrame:
    """A text of each kind, with its hash for an id."""
    return docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("doc_id"), "text")


def _item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """hash, size, said, item_id: the distinct windows of the items."""

    def make():
        def step(batch):
            words = words_in(batch.column("text"), LETTERS_AND_DIGITS)
            ids, text = batch.column("item_id").to_pylist(), words.text_of()
            rows = [(h, size, words.said(p, size), ids[text[p]]) for size, first in _own_windows(words, n).items() for p, h in zip(first.tolist(), rolled(words.hashes, size)[first].view(np.int64).tolist(), strict=True)]
            return dict(zip(("hash", "size", "said", "item_id"), map(list, zip(*rows, strict=True)), strict=True)) if rows else None

        return step

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return materialize(map_rows(items, ["item_id", "text"], make, "hash long, size int, said binary, item_id string").distinct(), "item-windows")


def _hits_by_tables(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, at, size, item_id of each hit. text_key keeps rows of one doc_id apart; equal texts have the same."""
    windows = _item_windows(benchmark, n)
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # n at most

    sent = docs.sparkSession.sparkContext.broadcast(filter_of(windows.select("hash").distinct(), hashed=True))

    def make():
        def step(batch):
            words = words_in(batch.column("text"), LETTERS_AND_DIGITS)
            text, found = words.text_of(), []
            for size in sizes:
                if len(text) >= size:
                    own = rolled(words.hashes, size)
                    at = np.flatnonzero((text[: len(own)] == text[size - 1 :]) & passes(sent.value, own))
                    found.append((text[at], at, np.full(len(at), size, np.int32), own[at].view(np.int64)))
            if not found:
                return None
            row, at, size, hashes = map(np.concatenate, zip(*found, strict=True))
            said = [words.said(a, k) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            return {c: batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")} | {"at": at - words.at[row], "size": size, "hash": hashes, "said": said}

        return step

    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    some = map_rows(keyed, ["doc_id", "text_key", "text"], make, "doc_id long, text_key long, at long, size int, hash long, said binary")
    return materialize(some.join(windows, ["hash", "size", "said"]).select("doc_id", "text_key", "at", "size", "item_id"), "hits")


def _judged_by_tables(docs: DataFrame, hits: DataFrame) -> DataFrame:
    by = ["doc_id", "text_key"]
    # Words that are hit and items of a row are distinct sets, counted by group: a row has no more words than its text, and no more items than the benchmark.
    hit_words = hits.select(*by, F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w")).distinct().groupBy(*by).agg(F.count("*").alias("n_hit"))
    own_items = hits.where("item_id IS NOT NULL").select(*by, "item_id").distinct().groupBy(*by).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    counts = map_rows(keyed, [*by, "text"], lambda: lambda b: {"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "n_words": np.diff(words_in(b.column("text"), LETTERS_AND_DIGITS).at)}, "doc_id long, text_key long, n_words long")
    for side in (hit_words, own_items):
        side = side.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
        counts = counts.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counts.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
