"""A language model as a probabilistic suffix tree over words, learnt and applied on all texts.

The contexts of the tree are the last words of a text, none up to a few of them. A context is kept where its next words differ enough from those of the longest kept
context that ends it: its training tokens, each left out of its own counts, must be likelier by a set gain in sum. A word's probability after a kept context is its
share there, smoothed by what the next shorter kept context says; the longest kept one is used.

How it runs: texts become blocks of coded words. For each depth the blocks send what they have seen, each pair of context and next word once with its count, to shards
by context; a shard adds up the counts, tests its contexts and answers each block in the order in which it asked. So nothing moves for each word of a text, the counts of the whole corpus
are only ever together by shards. Contexts seen very often are dealt out by next word as well; their gains are summed over the shards and tested like the others', before the blocks use the answers.
Of the model, the driver and the blocks only get those of them that are kept: fewer than the training tokens by `deal`.

A null text is an empty one, whose only token is the end; rows without an id are scored and not learnt from, as are those that the caller holds out; repeated rows count as often as
they are there; an empty table gives an empty one; other columns are not read. Words are told apart by 64-bit hashes, next words of a context by 40 bits of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import _bound_batches, _give_back, materialize, slices
from sieveline.llm.words import A, B, mixed, words_in

class Settings(NamedTuple):
    """depth: the longest contexts, in words. least: contexts seen less often are not tried. gain: what a context must gain on its training tokens, in log10. weight: how much
    the shorter context counts, as a power of the number of times that a context was seen. split: contexts seen more often are kept without a test, none unless asked for.
    deal: contexts seen more often are dealt out by next word, which doesn't change what is kept.
    block: words of a block, and shard: about what a shard gets of each depth. A block sends a row to each shard: for inputs that need very many of both, larger blocks send
    fewer rows. weight was chosen on another fold than the one held out by default."""

    depth: int = 2
    least: int = 8
    gain: float = 4.0
    weight: float = 0.9
    split: float = math.inf
    block: int = 700_000
    shard: int = 500_000
    deal: int = 500_000


#: The added count of the words without context.
ADDED = 0.1

_END = np.uint64(1)
_NEXT = np.uint64((1 << 40) - 1)
CODED = "block long, docs array<long>, held array<boolean>, lengths binary, vocabulary binary, times binary, seen binary, words binary, n long, learnt long"
ASKED = "block long, shard int, contexts binary, sizes binary, totals binary, nexts binary, counts binary, shorter binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
ANSWER = "depth int, block long, shard int, counts binary, v long, dealt binary, gains binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes: the high ones are mostly zeros, which compress."""
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _hashes(data: bytes) -> np.ndarray:
    """Sorted hashes from their differences."""
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _by_times(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times.astype(np.int64), kind="stable")


def _squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd").compress(data, asbytes=True)


def _loosen(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def _pack_next(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack_next(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(own), 8), np.uint8)
    wide[:, :5] = own
    return wide.view(np.uint64).ravel()


def _pack_log(logs: np.ndarray) -> bytes:
    """Negative logarithms in sixteenths, for the tests."""
    return np.clip(np.rint(-16 * logs), 0, 255).astype(np.uint8).tobytes()


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _arrow(ddl: str) -> pa.Schema:
    """Workers have no session that could read it."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def held_out(doc_id, remainder: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == remainder


def code(docs: DataFrame, remainder: int, block: int) -> DataFrame:
    """The texts of docs in blocks: which documents, how many tokens each, the block's vocabulary as sorted hashes, how often training texts have each, and the tokens as
    numbers in that vocabulary. Each text ends with a token of its own."""
    schema = _arrow(CODED)

    def made(nth: int, parts: list) -> pa.RecordBatch:
        docs_, held, lengths, hashes = ([x for p in parts for x in p[0]], [x for p in parts for x in p[1]], np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))
        vocabulary, _, words = _groups(hashes)
        learnt = np.repeat(~np.array(held, bool), lengths)
        seen = np.bincount(words[learnt], minlength=len(vocabulary))
        number = TaskContext.get().partitionId() << 32 | nth
        times = np.bincount(words, minlength=len(vocabulary))
        # Written as places by frequency: small numbers mostly, which compress.
        by_times = np.empty(len(vocabulary), np.int64)
        by_times[_by_times(times)] = np.arange(len(vocabulary))
        row = [number, docs_, held, _pack(lengths), _pack(np.diff(vocabulary, prepend=np.uint64(0))), _pack(times), _pack(seen), _squeeze(_pack(by_times[words])), len(words), int(learnt.sum())]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, nth = [], 0, 0
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            words = words_in(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            parts.append((ids, [held_out(i, remainder) for i in ids], np.diff(words.at) + 1, np.insert(words.hashes, words.at[1:], _END)))
            size += len(parts[-1][3])
            if size >= block:
                yield made(nth, parts)
                parts, size, nth = [], 0, nth + 1
        if parts:
            yield made(nth, parts)
        parts = batch = words = None
        _give_back()

    _bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, CODED)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with index and inverse, where any place of a value will do: by a sort that isn't stable, which is faster."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(values)]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Block:
    """What a block knows once the shards have answered: at each depth its pairs of context and next word, each once, in the order in which it asks."""

    def __init__(self, row: dict, answers: pa.Table, shards: int, tokens: int, distinct: int, depth: int, settings: Settings, kept_dealt: dict[int, np.ndarray] | None = None) -> None:
        self.row = row
        self.vocabulary = _hashes(row["vocabulary"])
        self.words = _by_times(_unpack(row["times"]))[_unpack(_loosen(row["words"], 8 * row["n"])).astype(np.int64)]
        self.lengths = _unpack(row["lengths"]).astype(np.int64)
        self.learnt = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)
        got: dict[int, list] = {}
        for d, shard, data in sorted(zip(*(answers.column(c).to_pylist() for c in ("depth", "shard", "counts")), strict=True), key=lambda r: r[:2]):
            got.setdefault(d, []).append(_unpack(data))
        self.seen = np.concatenate(got[0]).astype(np.float64)
        self.base = np.log10((self.seen + ADDED) / (tokens + ADDED * (distinct + 1)))[self.words]
        self.log = self.base.copy()
        # The context of depth 1 at a place is the word before it, of depth 2 the pair that ends there, and so on: its number, or -1.
        context = np.concatenate(([-1], self.words[:-1]))
        context[self.place == 0] = -1
        hashes, totals = self.vocabulary, self.seen
        for d in range(1, depth + 1):
            tried = np.flatnonzero(context >= 0)
            tried = tried[totals[context[tried]] >= settings.least]
            pairs, first, back = _groups(context[tried] * len(self.vocabulary) + self.words[tried])
            of, word = pairs // max(1, len(self.vocabulary)), pairs % max(1, len(self.vocabulary))
            nexts = self.vocabulary[word]
            dealt = np.where(totals[of] > settings.deal, mixed(hashes[of] + nexts * A), mixed(hashes[of] + B))
            shard = _shard_of(dealt, shards)
            # Numbers of two bytes are sorted by their digits.
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            self.asked = (d, of[order], nexts[order], hashes, totals, shard[order], np.bincount(back[self.learnt[tried]], minlength=len(pairs))[order], self.log[tried[first]][order])
            if d not in got:
                return
            answer = np.empty(len(pairs), np.uint64)
            answer[order] = np.concatenate(got[d])
            counts, kept = (answer >> np.uint64(1)).astype(np.float64), (answer & np.uint64(1)).astype(bool)
            kept |= np.isin(hashes[of], (kept_dealt or {}).get(d, ()))
            hit = np.flatnonzero(kept[back])
            use, pair = tried[hit], back[hit]
            n, c = totals[of[pair]], counts[pair]
            weight = n**settings.weight
            pair_at = np.full(len(self.words), -1)
            pair_at[tried] = back
            self.log[use] = np.log10((c + weight * 10 ** self.log[use]) / (n + weight))
            hashes, totals = mixed(hashes[of] * A + nexts + B), counts
            context = np.concatenate(([-1], pair_at[:-1]))
            context[self.place == 0] = -1

    def questions(self) -> list[dict]:
        """A row for each shard with anything to ask."""
        _, of, nexts, hashes, totals, shard, counts, shorter = self.asked
        rows, ends = [], np.flatnonzero(np.diff(shard, append=-1)) + 1
        begin = 0
        for end in ends.tolist():
            s = slice(begin, end)
            new = np.flatnonzero(np.diff(of[s], prepend=-1))
            each = of[s][new]
            rows.append({"block": self.row["block"], "shard": int(shard[begin]), "contexts": hashes[each].tobytes(), "sizes": _pack(np.diff(new, append=end - begin)), "totals": _pack(totals[each]), "nexts": _pack_next(nexts[s] & _NEXT), "counts": _pack(counts[s]), "shorter": _pack_log(shorter[s])})
            begin = end
        return rows

    def scores(self) -> dict:
        """A row for each document."""
        def total(x):
            return np.add.reduceat(x, self.starts)

        known = self.seen[self.words] > 0
        return {"doc_id": self.row["docs"], "held_out": self.row["held"], "n_tokens": self.lengths, "n_known": total(known.astype(np.int64)), "base_score": total(self.base), "score": total(self.log)}


def _words_by_shard(coded: DataFrame, shards: int) -> DataFrame:
    schema = _arrow("block long, shard int, keys binary, counts binary")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, seen = _hashes(row["vocabulary"]), _unpack(row["seen"])
                at = np.searchsorted(_shard_of(keys, shards), np.arange(shards + 1))
                rows = [{"block": row["block"], "shard": s, "keys": _pack(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": _pack(seen[a:b])} for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return coded.select("block", "vocabulary", "seen").mapInArrow(run, "block long, shard int, keys binary, counts binary")


def _answered(depth: int, group: pa.Table, sizes: list[int], values: np.ndarray, distinct: int, dealt: bytes = b"", gains: bytes = b"") -> pa.Table:
    ends = np.cumsum(sizes)
    rows = [{"depth": depth, "block": b, "shard": s, "counts": _pack(values[e - n : e]), "v": distinct if i == 0 else 0, "dealt": dealt if i == 0 else b"", "gains": gains if i == 0 else b""} for i, (b, s, n, e) in enumerate(zip(group.column("block").to_pylist(), group.column("shard").to_pylist(), sizes, ends.tolist(), strict=True))]
    return pa.Table.from_pylist(rows, schema=_arrow(ANSWER))


def _count_words(group: pa.Table) -> pa.Table:
    keys = [_hashes(k) for k in group.column("keys").to_pylist()]
    counts = np.concatenate([_unpack(c) for c in group.column("counts").to_pylist()])
    every, _, back = _groups(np.concatenate(keys))
    total = np.bincount(back, counts, len(every))
    return _answered(0, group, [len(k) for k in keys], total[back], int((total > 0).sum()))


def _test_contexts(depth: int, group: pa.Table, settings: Settings) -> pa.Table:
    """Adds up the counts of a shard's pairs, and tests its contexts: twice the count of each pair, and one more where its context is kept.
    Of contexts that are dealt out, the shard only has a part: it tells what they gain in it, and keeps none."""
    parts = [(np.frombuffer(r["contexts"], np.uint64), _unpack(r["sizes"]).astype(np.int64), _unpack(r["totals"])) for r in group.select(["contexts", "sizes", "totals"]).to_pylist()]
    lengths = [int(sizes.sum()) for _, sizes, _ in parts]
    context = np.concatenate([np.repeat(c, sizes) for c, sizes, _ in parts])
    seen = np.concatenate([np.repeat(t, sizes) for _, sizes, t in parts]).astype(np.float64)
    nexts = np.concatenate([_unpack_next(x) for x in group.column("nexts").to_pylist()])
    counts = np.concatenate([_unpack(x) for x in group.column("counts").to_pylist()])
    shorter = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("shorter").to_pylist()])
    _, first, back = _groups(mixed(context + nexts * A))
    c = np.bincount(back, counts, len(first))
    n, p = seen[first], 10.0 ** (shorter[first].astype(np.float64) / -16)
    weight = n**settings.weight
    # Each training token against the counts without itself.
    gain = np.where(c > 0, c * (np.log10(np.maximum(c - 1, 0) + weight * p) - np.log10(n - 1 + weight) - np.log10(p)), 0.0)
    contexts, own = np.unique(context[first], return_inverse=True)
    gains = np.bincount(own, gain, len(contexts))
    whole = n <= settings.deal
    parted = np.unique(own[~whole])
    return _answered(depth, group, lengths, (2 * c + ((whole & (gains[own] >= settings.gain)) | (n > settings.split)))[back], 0, contexts[parted].tobytes(), gains[parted].tobytes())


def _kept_of_dealt(answers: DataFrame, settings: Settings) -> np.ndarray:
    """The dealt contexts whose gains over all shards are enough, as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dealt, gains in zip(batch.column("dealt").to_pylist(), batch.column("gains").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(dealt, np.int64)), pa.array(np.frombuffer(gains, np.float64))], ["context", "gain"])

    parts = answers.where("length(dealt) > 0").select("dealt", "gains").mapInArrow(run, "context long, gain double")
    # In the order of the shards' parts whatever arrives first: the sum's last digits don't hang on it.
    sums = parts.groupBy("context").agg(F.aggregate(F.array_sort(F.collect_list("gain")), F.lit(0.0), lambda a, x: a + x).alias("gain"))
    return np.sort(sums.where(F.col("gain") >= settings.gain).select("context").toArrow().column("context").to_numpy().astype(np.int64).view(np.uint64))


def score(docs: DataFrame, remainder: int = 0, settings: Settings = Settings()) -> DataFrame:  # noqa: B008  a tuple
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; crc32 of the id modulo 10 of `remainder` is held out of the learning."""
    coded = materialize(code(docs, remainder, settings.block), "coded")
    size = coded.agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")).first()
    shards = max(1, -(-(size["n"] or 0) // settings.shard))
    tokens = size["learnt"] or 0
    answers = materialize(_words_by_shard(coded, shards).groupBy("shard").applyInArrow(_count_words, ANSWER), "answers")
    distinct = answers.agg(F.sum("v").alias("v")).first()["v"] or 0

    kept: dict[int, np.ndarray] = {}

    def asking(d: int):
        def ask(block: pa.Table, got: pa.Table) -> pa.Table:
            rows = [q for r in block.to_pylist() for q in Block(r, got, shards, tokens, distinct, d, settings, kept).questions()]
            _give_back()
            return pa.Table.from_pylist(rows, schema=_arrow(ASKED))

        return ask

    def testing(d: int):
        return lambda group: _test_contexts(d, group, settings)

    for d in range(1, settings.depth + 1):
        asked = coded.groupBy("block").cogroup(answers.drop("dealt", "gains").groupBy("block")).applyInArrow(asking(d), ASKED)
        found = asked.groupBy("shard").applyInArrow(testing(d), ANSWER)
        found = materialize(found, "answers")
        kept[d] = _kept_of_dealt(found, settings)
        # The blocks don't read the gains again.
        answers = answers.unionByName(found)
    out = _arrow(SCORES)

    def rate(block: pa.Table, got: pa.Table) -> pa.Table:
        rows = [Block(r, got, shards, tokens, distinct, settings.depth, settings, kept).scores() for r in block.to_pylist()]
        _give_back()
        return pa.concat_tables([pa.table([pa.array(r[f.name], f.type) for f in out], schema=out) for r in rows] or [out.empty_table()])

    rated = coded.groupBy("block").cogroup(answers.drop("dealt", "gains").groupBy("block")).applyInArrow(rate, SCORES)
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
