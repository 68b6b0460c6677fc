"""Language identification, toxicity and quality: exact parts against brute force, models by held-out accuracy."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from tests.llm.cases import ROWS, documents, empty

from sieveline.llm import language_id, ngrams, toxicity
from sieveline.llm import quality_classifier as Q
from sieveline.llm.common import fold
from sieveline.llm.ngrams import hashed_ngrams


def test_viterbi_is_the_best_labelling():
    draw = np.random.default_rng(1)
    for _ in range(100):
        n, k = int(draw.integers(1, 6)), int(draw.integers(1, 4))
        scores = draw.normal(0, 3, (n, k)).astype(np.float32)

        def total(path, scores=scores):
            return sum(scores[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        best = max(total(p) for p in itertools.product(range(k), repeat=n))
        assert abs(total(language_id.viterbi(scores, 2.0)) - best) < 1e-4


def test_the_short_cut_is_the_full_pass():
    draw = np.random.default_rng(2)
    label = language_id.Labeller(language_id.Model([("x", 1, 1), ("y", 2, 1), ("z", 3, 1)]), 4.0)
    for _ in range(300):
        scores = draw.normal([1.0, 0, 0], 1.2, (int(draw.integers(1, 40)), 3)).astype(np.float32)

        def total(path, scores=scores):
            return scores[np.arange(len(path)), path].sum() - 4.0 * (np.diff(path) != 0).sum()

        assert abs(total(label.path(scores)) - total(language_id.viterbi(scores, 4.0))) < 1e-3


def test_ngrams_are_those_of_each_word():
    words = ["abc", "é", "abcd", "zz"]
    owner, bucket = hashed_ngrams(words, (2, 3), 1 << 20)
    for i, w in enumerate(words):
        alone = hashed_ngrams([w], (2, 3), 1 << 20)[1]
        assert sorted(bucket[owner == i]) == sorted(alone)
        assert len(alone) == sum(len(w) + 2 - n + 1 for n in (2, 3) if len(w) + 2 >= n) + 1


def test_mixed_texts_are_cut_into_spans():
    rows = []
    for lang, words in (("en", "the house and the river with that stone"), ("de", "das haus und der fluss mit jenem stein")):
        _, bucket = next(language_id.grams(words.split()))
        rows += [(lang, int(b), 5) for b in bucket] + [(lang, language_id.BUCKETS + language_id.SCRIPTS.index("latin"), 100)]
    label = language_id.Labeller(language_id.Model(rows), 3.0)
    spans = label.spans("the river and the stone with that house das haus und der stein mit jenem fluss")
    assert [(a, b, x) for a, b, x in spans] == [(0, 8, "en"), (8, 16, "de")]


def test_language_accuracy_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [r for r in docs.collect() if fold(r.doc_id) == 2 and r.lang]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.9 * len(held)
    odd = {(r.doc_id, r.lang_pred) for r in language_id.identify(documents(spark)).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (14, "und")} <= odd
    assert language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents(spark, [(1, "words here", None, "a")])).collect()} == {"und"}
    assert not {4, 5, 6, 14} & {r.doc_id for r in language_id.accepted(documents(spark)).collect()}


def test_toxicity_separates_held_out_rows_and_misspellings(spark):
    draw = np.random.default_rng(3)
    base = [f"{a}{b}{c}" for a in ("stone", "river", "lamp", "wood", "hill") for b in ("er", "ing", "ly", "est") for c in ("a", "o", "i", "u")]
    rows, labels = [], []
    for i in range(1200):
        words = [base[k] for k in draw.integers(0, len(base), 60)]
        toxic = i % 5 == 0
        if toxic:
            for k in draw.integers(0, 60, 4):
                words[k] = ["scumbag", "idiotic", "worthless"][k % 3]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(toxic)))
    rows += [(5000, " ".join(base[:56] + ["scumbagg", "idiotiic", "worthlesss", "scumbagz"]), "en", "a"), (5001, " ".join(base[:60]), "en", "a"), (5002, "", "en", "a"), (5003, None, "en", "a")]
    marked = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(documents(spark, rows), marked).collect()}
    held = [(i, x) for i, x in labels if fold(i) == 2]
    assert sum(found[i].predicted == x for i, x in held) >= 0.97 * len(held)
    assert found[5000].predicted == 1 and found[5001].predicted == 0
    assert 0 <= found[5002].score <= 1 and found[5002].score == found[5003].score


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (11, 0)], "doc_id long, toxic int")
    assert toxicity.score(documents(spark), labels).count() == len(ROWS)
    assert toxicity.score(empty(spark), labels).count() == 0
    assert {r.score for r in toxicity.score(documents(spark), labels.limit(0)).collect()} == {0.0}


def plain_loss(weights, gaps, rows, grades):
    """Summed over texts and cuts, one at a time."""
    cuts = [gaps[0] + sum(math.exp(g) for g in gaps[1 : k + 1]) for k in range(len(gaps))]
    total = 0.0
    for own, grade in zip(rows, grades, strict=True):
        score = sum(weights[b] * x for b, x in own)
        total += sum(-math.log(p if grade > k else 1 - p) for k, c in enumerate(cuts) for p in [1 / (1 + math.exp(c - score))])
    return total / len(rows) + 1e-6 / 2 * sum(w * w for w in weights)


def test_ordinal_gradients_are_those_of_the_plain_loss():
    draw = np.random.default_rng(5)
    rows = [[(int(b), float(draw.normal())) for b in draw.integers(0, 6, 4)] for _ in range(12)]
    grades, weights, gaps = draw.integers(0, 4, 12), draw.normal(size=6), draw.normal(size=3)
    features = tuple(map(np.array, zip(*((i, b, x) for i, own in enumerate(rows) for b, x in own), strict=True)))
    loss, by_weight, by_gap = Q.loss_and_gradients(weights, gaps, features, grades)
    assert abs(loss - plain_loss(weights, gaps, rows, grades)) < 1e-9
    for params, grads in ((weights, by_weight), (gaps, by_gap)):
        for i in range(len(params)):
            old = params[i]
            params[i] = old + 1e-5
            up = plain_loss(weights, gaps, rows, grades)
            params[i] = old - 1e-5
            down = plain_loss(weights, gaps, rows, grades)
            params[i] = old
            assert abs((up - down) / 2e-5 - grads[i]) < 1e-6


def graded(spark, levels):
    """Texts of which one kind of words is the more frequent, the higher the grade."""
    draw, rows, labels = np.random.default_rng(7), [], []
    for i in range(900):
        k = i % len(levels)
        rows.append((i, " ".join(f"{'fine' if draw.random() < 0.1 + 0.25 * k else 'poor'}{draw.integers(0, 20)}" for _ in range(60)), "en", "a"))
        labels.append((i, levels[k]))
    return documents(spark, rows), spark.createDataFrame(labels + [(None, levels[0]), (3, None)], "doc_id long, quality int"), dict(labels)


def test_several_grades_are_ordered(spark):
    docs, labels, true = graded(spark, [-2, 0, 3, 4])
    model = Q.fit(docs, labels)
    assert model.levels == [-2, 0, 3, 4] and (np.diff(model.cuts) > 0).all()
    found = Q.grade(docs, labels, least=3).collect()
    held = [r for r in found if r.held_out]
    means = [np.mean([r.expected_grade for r in held if true[r.doc_id] == level]) for level in model.levels]
    assert means == sorted(means) and np.mean([abs(r.expected_grade - true[r.doc_id]) for r in held]) < 1.0
    assert all(-2 <= r.expected_grade <= 4 and r.selected == (r.p_tail >= 0.5) for r in found)
    assert np.mean([r.selected == (true[r.doc_id] >= 3) for r in held]) > 0.9


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (11, 1), (11, 0)], "doc_id long, quality int")
    found = Q.grade(documents(spark), labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r.expected_grade <= 1 for r in found)
    assert len({r.p_tail for r in found if r.doc_id in (4, 5, 6)}) == 1 and all(r.held_out for r in found if r.doc_id is None)
    assert len({r.p_tail for r in found if r.doc_id in (1, 2)}) == 1
    assert Q.grade(empty(spark), labels).count() == 0
    assert {(r.expected_grade, r.selected) for r in Q.grade(documents(spark), labels.limit(0)).collect()} == {(0.0, False)}
    one = spark.createDataFrame([(1, 2), (3, 2)], "doc_id long, quality int")
    assert {(r.expected_grade, r.p_tail) for r in Q.grade(documents(spark), one).collect()} == {(2.0, 1.0)}


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs, labels, _ = graded(spark, [0, 1])
    again = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 40"))
    assert np.allclose(Q.fit(docs, labels).cuts, Q.fit(again, labels).cuts)
    marked = labels.withColumnRenamed("quality", "toxic")
    assert np.allclose(toxicity.fit(docs, marked).by_gram, toxicity.fit(again, marked).by_gram)


def test_quality_tells_held_out_rows_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    true = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.p_tail, true[r.doc_id]) for r in Q.grade(docs, labels).collect() if r.held_out and r.doc_id in true]
    good, bad = [p for p, x in held if x], [p for p, x in held if not x]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.75


@pytest.mark.parametrize("at_once", [7, 64, 1_000])
def test_ngrams_in_blocks_are_the_same(monkeypatch, at_once):
    """Words of any length, cut anywhere; the hash of the whole word too."""
    monkeypatch.setattr(ngrams, "CHARS_AT_ONCE", at_once)
    words = ["a", "short", "", "w" * 200, "éü中" * 50, "x", "abcdefg" * 9, "ends"]
    owner, bucket = hashed_ngrams(words, (1, 3, 5), 1 << 16)
    blocks = list(ngrams.ngram_blocks(words, (1, 3, 5), 1 << 16))
    assert all(len(b) <= 4 * at_once + 60 for _, b in blocks) and all((np.diff(o) >= 0).all() for o, _ in blocks)
    assert sorted(zip(owner.tolist(), bucket.tolist(), strict=True)) == sorted((i, b) for o, own in blocks for i, b in zip(o.tolist(), own.tolist(), strict=True))


def test_one_word_of_many_megabytes():
    word = "".join(chr(97 + i * i % 23) for i in range(2_000_000))
    tracemalloc.start()
    toxicity.Model(np.zeros(toxicity.BUCKETS), 1.0, 0.0).parts([word])
    language_id.Model([("en", 1, 5), ("de", 2, 5)]).parts([word])
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()


def test_rare_labels_are_not_learnt(spark):
    rows = [(i, "some plain words of one kind", "en", "a") for i in range(1_500)] + [(9_000 + i, f"qq{i} zz", f"odd{i}", "a") for i in range(700)]
    model = language_id.fit(documents(spark, rows))
    assert model.langs == ["en"]


def test_ngrams_of_many_words_take_little_memory_at_once():
    import tracemalloc

    from sieveline.llm import ngrams

    words = [f"word{i}" for i in range(60_000)]
    tracemalloc.start()
    n = sum(len(bucket) for _, bucket in ngrams.ngram_blocks(words, (1, 2, 3, 4), 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Marks before and after each word count; the word itself is one more.
    assert n == sum(4 * (len(w) + 2) - 6 + 1 for w in words)
    assert peak < 50_000_000, peak
