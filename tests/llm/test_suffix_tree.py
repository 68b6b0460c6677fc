import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.cases import ROWS, documents, empty

from sieveline.llm import suffix_tree as S

SPACES = " \t\n\v\f\r"


def words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in SPACES else c for c in small).split(" ") if w]


def brute(rows, s, remainder=0):
    docs = [(d, S.held_out(d, remainder), [*words(t), None]) for d, t, *_ in rows]
    seen = Counter(w for _, held, ws in docs if not held for w in ws)
    n, v = sum(seen.values()), len(seen)
    base = lambda w: math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1)))
    log = [[base(w) for w in ws] for _, _, ws in docs]
    totals = {(w,): c for w, c in seen.items()}
    for d in range(1, s.depth + 1):
        at = [(i, j, tuple(ws[j - d : j]), ws[j]) for i, (_, _, ws) in enumerate(docs) for j in range(d, len(ws)) if totals.get(tuple(ws[j - d : j]), 0) >= s.least]
        counts, parent = Counter(), {}
        for i, j, context, w in at:
            counts[context, w] += not docs[i][1]
            parent.setdefault((context, w), log[i][j])
        gain = defaultdict(float)
        for (context, w), c in counts.items():
            p = 10 ** (-min(255, round(-16 * parent[context, w])) / 16)
            if c:
                weight = totals[context] ** s.weight
                gain[context] += c * math.log10((c - 1 + weight * p) / (totals[context] - 1 + weight) / p)
        for i, j, context, w in at:
            if gain[context] >= s.gain or totals[context] > s.split:
                weight = totals[context] ** s.weight
                log[i][j] = math.log10((counts[context, w] + weight * 10 ** log[i][j]) / (totals[context] + weight))
        totals = {(*context, w): c for (context, w), c in counts.items()}
    return sorted(((d, held, len(ws), sum(seen[w] > 0 for w in ws), n, sum(map(base, ws)), sum(own)) for (d, held, ws), own in zip(docs, log, strict=True)), key=repr)


def check(spark, rows, s):
    found = sorted((tuple(r) for r in S.score(documents(spark, rows), settings=s).collect()), key=repr)
    want = brute(rows, s)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return found


def chained(seed, n):
    """Texts in which a word tells much of the next one, and two words more."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, text = "w0", "w1", []
        for _ in range(draw.randint(0, 60)):
            a, b = b, f"w{(int(a[1:]) * 3 + int(b[1:]) + draw.choice([0, 0, 0, 1, 5])) % 17}" if draw.random() < 0.9 else f"w{draw.randint(0, 60)}"
            text.append(b)
        rows.append((i, " ".join(text), "en", "a"))
    return rows


@pytest.mark.parametrize("split", [100, 10**6])
def test_equals_a_plain_model(spark, split):
    """Several blocks and shards; with and without contexts that are dealt out by next word."""
    rows = chained(split, 400)
    found = check(spark, rows, S.Settings(least=4, gain=1.0, split=split, block=900, shard=700))
    base, own = (sum(r[k] for r in found if r[1]) for k in (5, 6))
    assert own > 0.8 * base  # both are negative: held-out texts are likelier


def test_deeper_contexts(spark):
    check(spark, chained(7, 150), S.Settings(depth=3, least=3, gain=0.5, block=5_000, shard=2_000))


def test_odd_rows(spark):
    check(spark, ROWS, S.Settings(least=2, gain=0.1))
    assert S.score(empty(spark)).count() == 0
    check(spark, [(None, "a b", "en", "a"), (None, None, "en", "a")], S.Settings())


def test_dealt_contexts_are_tested_too(spark):
    """How often a context is seen decides where it is counted, not whether it is kept: words that tell nothing of the next one gain nothing."""
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["a", "b", "c", "d"]) for _ in range(60)), "en", "a") for i in range(60)] + [(60 + i, "x y " * 30, "en", "a") for i in range(20)]
    found = [sorted(S.score(documents(spark, rows), settings=S.Settings(least=4, gain=5.0, deal=deal, block=700, shard=300)).collect()) for deal in (50, 10**9)]
    check(spark, rows, S.Settings(least=4, gain=5.0, split=10**9, deal=50, block=700, shard=300))
    assert S.Settings().split == math.inf
    for a, b in zip(*found, strict=True):
        assert tuple(a)[:5] == tuple(b)[:5] and tuple(a)[5:] == pytest.approx(tuple(b)[5:], rel=1e-9)


@pytest.mark.parametrize("n", [0, 1, 5, 3_000])
def test_groups_are_the_sorted_distinct_values(n):
    """As a plain sort of distinct values has them, for signed and unsigned ones."""
    draw = np.random.default_rng(n)
    for values in (draw.integers(-40, 40, n), draw.integers(0, 1 << 64, n, np.uint64) // np.uint64(1 << 58)):
        found, first, back = S._groups(values)
        assert found.tolist() == sorted(set(values.tolist())) and values[first].tolist() == found.tolist() and found[back].tolist() == values.tolist()
