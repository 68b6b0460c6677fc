import random
import struct
import zlib

import public_tokenizers
import pytest
from tests.llm.cases import ROWS, documents, empty, rows_of
from tokenizers import Tokenizer

from sieveline.llm import common
from sieveline.llm.bpe import Bpe, prove_whole_tokens
from sieveline.llm.common import held, map_rows
from sieveline.llm.packing import CapacityTree, best_fit_decreasing, pack
from sieveline.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    text = open(PATH, encoding="utf-8").read()
    return Bpe(text, prove_whole_tokens(text))


def test_ids_equal_the_librarys_on_odd_texts(library, own):
    draw = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "The", "é", "12", "²", "½", "　", "中", "​", "<|endoftext|>", "'s", "'", "ſ", ".", "...", "\x85", "\xa0", "ǅ", "😀", "ا", "\x1c", "_", "-"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.packed(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert own.count(text) == len(ids)


def test_plain_texts_are_merged_whole_and_not_remembered(library):
    text = open(PATH, encoding="utf-8").read()
    fresh = Bpe(text, prove_whole_tokens(text))
    draw = random.Random(7)
    for _ in range(300):
        plain = "".join(draw.choice([" ", "the", "Ébç", "'re", "12²", "\n\n", "\t", "_x", "\xa0", "\x85", "."]) for _ in range(draw.randint(0, 40)))
        ids = library.encode(plain, add_special_tokens=False).ids
        assert fresh.packed(plain) == struct.pack(f"<{len(ids)}I", *ids) and fresh.count(plain) == len(ids), repr(plain)
    assert not fresh.part_ids and not fresh.part_counts and not fresh.piece_ids
    for long in ("a" + " " * 2_000_000 + "b", "\n" * 20_000, "ab" * 100_000):
        assert fresh.count(long) == len(library.encode(long, add_special_tokens=False).ids)


def test_whole_tokens_are_proved(library, own):
    draw = random.Random(6)
    for text in draw.sample(sorted(own.whole), 500):
        assert library.encode(text, add_special_tokens=False).ids == [own.whole[text]]


def test_counts(spark, library):
    found = count_tokens(documents(spark), PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted((d or -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _, _ in ROWS)
    assert count_tokens(empty(spark), PATH).count() == 0


def naive_bins(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= x]
        (min(fits, key=lambda b: capacity - sum(b)) if fits else bins.append([]) or bins[-1]).append(x)
    return sorted(sorted(b) for b in bins)


@pytest.mark.parametrize("seed", range(30))
def test_counted_best_fit_is_best_fit(seed):
    draw = random.Random(seed)
    capacity = draw.choice([8, 16, 50, 100])
    lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 200))]
    slots, bins = best_fit_decreasing({x: lengths.count(x) for x in set(lengths)}, capacity)
    places = {}
    for length, lo, hi, first, per_bin, offset in slots:
        for r in range(lo, hi):
            places.setdefault(first + (r - lo) // per_bin, []).append((offset + (r - lo) % per_bin * length, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == bins == len(naive_bins(lengths, capacity))
    assert sorted(x for own in places.values() for _, x in own) == sorted(lengths)


def test_tree_finds_the_tightest():
    draw = random.Random(3)
    tree, held = CapacityTree(100), []
    for _ in range(500):
        x = draw.randint(1, 100)
        if held and draw.random() < 0.4:
            tree.add(held.pop(draw.randrange(len(held))), -1)
        held.append(x)
        tree.add(x, 1)
        want = draw.randint(1, 100)
        assert tree.tightest(want) == min((h for h in held if h >= want), default=None)


def test_packing_round_trip(spark, library):
    found = pack(documents(spark), PATH).collect()
    whole = {}
    for d, t, _, _ in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [ids[: len(ids) % 1024], *(ids[k : k + 1024] for k in range(len(ids) % 1024, len(ids), 1024))]
        cut = [c for c in cut if c]
        for piece, own in enumerate(cut):
            start = sum(map(len, cut[:piece]))
            whole.setdefault((d, piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))), []).append(1)
    assert sorted((repr(tuple(r[:5])) for r in found)) == sorted(repr(k) for k, v in whole.items() for _ in v)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) == len(naive_bins([r.length for r in found], 1024))
    assert pack(empty(spark), PATH).count() == 0


def test_a_worker_holds_what_tasks_ask_for_until_another_operators_task_comes(spark):
    docs = documents(spark).repartition(3)

    def task(key):
        def make():
            born = held(key, lambda: [0]) if key else None
            if born is not None:
                born[0] += 1

            def step(batch):
                return {"key": [str(key)] * batch.num_rows, "tasks": [born[0] if born else len(common._held)] * batch.num_rows}

            return step

        return {r["tasks"] for r in map_rows(docs.coalesce(1), ["text"], make, "key string, tasks int").collect()}

    first = task("one")
    assert first == {1}
    assert task(None) == {0}  # what "one" held is gone
    assert task("one") == {1}  # so it is computed anew


def test_counts_and_pieces_are_the_same_whatever_ran_before(spark):
    docs = documents(spark)
    before = rows_of(count_tokens(docs, PATH))
    rows_of(map_rows(docs, ["doc_id", "text"], lambda: lambda batch: {"doc_id": batch.column("doc_id")}, "doc_id long"))
    assert rows_of(count_tokens(docs, PATH)) == before
