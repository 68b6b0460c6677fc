"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of itself, a text's the mean of its words' (damped, see
PSEUDO_WORDS and WORD_SHARE). So a misspelling
that was never seen shares most vectors with the word that it stands for. As the output is linear in the mean, scoring a text needs one
number for each n-gram, and a worker remembers the numbers of the words it has seen; whole texts are scored.

The model is fitted to a bounded sample of labelled rows (`max_rows` of each label, chosen by a hash of doc_id); rows that the sample has too
many of weigh less, so scores keep the labels' rates. Null texts are empty; empty texts get the score of the labels' rate.
Rows of labels with null doc_id or label aren't learnt from; of several labels of a doc_id the largest counts, of several rows of a sampled doc_id one, so
the sample is bounded however often they repeat. Repeated rows give repeated rows,
a null doc_id stays null and counts as held out, other columns are not read. Without labelled rows all scores are 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import fold, fold_column, map_rows
from sieveline.llm.ngrams import PartTable, hashed_ngrams, ngram_blocks

BUCKETS = 1 << 17
#: Characters of an n-gram.
SIZES = (3, 4, 5)
#: Labelled rows of each label that the model is fitted to, about.
MAX_ROWS = 2_000
THRESHOLD = 0.3
#: Words of no meaning that each text's mean has besides its own, so that a few words don't decide.
PSEUDO_WORDS = 60.0
#: Share of a text's words, and number, that one word counts for at most: a text that repeats a word says no more than a few times it.
WORD_SHARE, WORD_TIMES = 0.02, 2.0

words_in = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*").findall


def most_times(n: float | np.ndarray) -> float | np.ndarray:
    """How often a word counts at most in a text of n words."""
    return np.maximum(WORD_TIMES, WORD_SHARE * n)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of the words' n-grams of 3 to 5 characters and of the words themselves."""
    return hashed_ngrams(words, SIZES, BUCKETS)


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by groups, which are sorted."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(groups):
        first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out


class Bags:
    """The two sparse averaging matrices (text by word, word by n-gram), sorted either way."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, n_rows: int, n_columns: int) -> None:
        self.shape = n_rows, n_columns
        by_row, by_column = np.lexsort((columns, rows)), np.lexsort((rows, columns))
        self.forth = rows[by_row], columns[by_row], weights[by_row, None].astype(np.float32)
        self.back = columns[by_column], rows[by_column], weights[by_column, None].astype(np.float32)

    def dot(self, x: np.ndarray) -> np.ndarray:
        rows, columns, w = self.forth
        return _sums(x[columns] * w, rows, self.shape[0])

    def transposed_dot(self, x: np.ndarray) -> np.ndarray:
        columns, rows, w = self.back
        return _sums(x[rows] * w, columns, self.shape[1])


def train(texts: Bags, words: Bags, labels: np.ndarray, weights: np.ndarray, dim: int = 4, steps: int = 160, rate: float = 0.12, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """A number for each n-gram and the bias: the logit of label 1 is their mean by word and text, plus the bias. Adam on all rows at once."""
    draw = np.random.default_rng(6)
    n = words.shape[1]
    params = [draw.normal(0, 0.1, (n, dim)).astype(np.float32), draw.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    rate_1 = float((weights * labels).sum() / weights.sum())
    params[2][:] = np.log(max(1e-4, 1 - rate_1)), np.log(max(1e-4, rate_1))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = np.stack([1 - labels, labels], axis=1).astype(np.float32)
    # Rare labels count as much as frequent ones while the embeddings are learnt; the bias is set to the true rate afterwards.
    share = np.where(labels == 1, 0.5 / max(1e-9, weights[labels == 1].sum()), 0.5 / max(1e-9, weights[labels == 0].sum()))
    w = (weights * share).astype(np.float32)[:, None]
    for step in range(1, steps + 1):
        vectors = words.dot(params[0])
        means = texts.dot(vectors)
        z = means @ params[1] + params[2]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        off = (p - target) * w
        grads = [words.transposed_dot(texts.transposed_dot(off @ params[1].T)) + decay * params[0], means.T @ off, off.sum(axis=0)]
        for k, (p, g, (m, v)) in enumerate(zip(params, grads, moments, strict=True)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    line = params[1][:, 1] - params[1][:, 0]
    return params[0] @ line, float(params[2][1] - params[2][0])


class Model:
    """Scores by n-gram, with the bias."""

    def __init__(self, by_gram: np.ndarray, slope: float, bias: float) -> None:
        self.by_gram, self.slope, self.bias = by_gram.astype(np.float32), slope, bias

    def words(self, words: list[str]) -> np.ndarray:
        """The words' numbers: the means of their n-grams'."""
        total, n = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for owner, bucket in ngram_blocks(words, SIZES, BUCKETS):
            a, b = (int(owner[0]), int(owner[-1]) + 1) if len(owner) else (0, 0)
            total[a:b] += np.bincount(owner - a, weights=self.by_gram[bucket], minlength=b - a)
            n[a:b] += np.bincount(owner - a, minlength=b - a)
        return total / np.maximum(1, n)

    def parts(self, chunks: list[str]) -> np.ndarray:
        """Sum of the words' numbers, and number of words, of each chunk."""
        words, owner = [], []
        for i, chunk in enumerate(chunks):
            own = [chunk.lower()] if chunk.isalpha() else words_in(chunk.lower())
            words += own
            owner += [i] * len(own)
        owner = np.array(owner, np.int64)
        return np.stack([np.bincount(owner, weights=self.words(words), minlength=len(chunks)), np.bincount(owner, minlength=len(chunks))], axis=1)

    def logits(self, table: PartTable, texts: pa.Array) -> np.ndarray:
        return self.bias + self.slope * np.array([self._mean(table, at) for at in table.numbers(texts)])

    @staticmethod
    def _mean(table: PartTable, at: np.ndarray) -> float:
        at, times = np.unique(at, return_counts=True)
        rows = table.rows[at]
        n = float(times @ rows[:, 1])
        return float(np.minimum(times, most_times(n)) @ rows[:, 0]) / (n + PSEUDO_WORDS)


def _sample(labels: DataFrame, max_rows: int) -> dict[int, tuple[int, float]]:
    """doc_id to label and weight, of at most about max_rows rows of each label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_column() != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, max_rows / v) for k, v in n.items()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(chance < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))).select("doc_id", "toxic").collect()
    return {r["doc_id"]: (r["toxic"], 1 / share[r["toxic"]]) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    sample = _sample(labels, max_rows)
    if not sample:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(sample))

    def make():
        wanted = sent.value

        def step(batch):
            rows = [(d, sorted(Counter(words_in(t.lower())).items())) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if d in wanted and t]
            return {"doc_id": [d for d, _ in rows], "words": [[w for w, _ in c] for _, c in rows], "n": [[n for _, n in c] for _, c in rows]} if rows else None

        return step

    ids = docs.where(F.col("doc_id").isNotNull())
    # A row for each sampled id, whatever the number of rows that have it; in order, so that the fit doesn't depend on the partitioning.
    found = map_rows(ids, ["doc_id", "text"], make, "doc_id long, words array<string>, n array<int>").groupBy("doc_id").agg(F.min(F.struct("words", "n")).alias("x"))
    found = found.select("doc_id", "x.*").toArrow().sort_by("doc_id").combine_chunks()
    if not found.num_rows:
        return None
    lists = found.column("words").combine_chunks() if isinstance(found.column("words"), pa.ChunkedArray) else found.column("words")
    lengths = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), found.column("n").combine_chunks().flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    vocabulary = coded.dictionary.to_pylist()
    total = np.bincount(row, weights=n, minlength=len(lengths))
    # Words of one or two texts say little about others as words; their share of the text stays as weight that goes nowhere.
    kept = np.bincount(code, minlength=len(vocabulary)) >= 3
    renumbered = np.cumsum(kept) - 1
    some = kept[code]
    texts = Bags(row[some], renumbered[code[some]], np.minimum(n[some], most_times(total[row[some]])) / (total[row[some]] + PSEUDO_WORDS), len(lengths), int(kept.sum()))
    own, bucket = subwords([w for w, k in zip(vocabulary, kept, strict=True) if k])
    sizes = np.bincount(own, minlength=int(kept.sum()))
    words = Bags(own, bucket, 1 / sizes[own], len(sizes), BUCKETS)
    marks = [sample[d] for d in found.column("doc_id").to_pylist()]
    labels_, weights = np.array([a for a, _ in marks]), np.array([b for _, b in marks])
    # A fifth of the rows is left for the calibration.
    left = np.array([zlib.crc32(f"calibrate {d}".encode()) % 5 == 0 for d in found.column("doc_id").to_pylist()])
    by_gram, _ = train(texts, words, labels_, np.where(left, 0.0, weights))
    means = texts.dot(words.dot(by_gram[:, None].astype(np.float32)))[:, 0]
    rows = left if len(set(labels_[left])) == 2 else np.ones(len(left), bool)
    return Model(by_gram, *calibrate(means[rows].astype(np.float64), labels_[rows], weights[rows]))


def calibrate(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Slope and bias of a logistic regression of labels on x, by Newton steps with a weak pull of the scaled slope to 0."""
    middle, spread = float(np.average(x, weights=weights)), float(x.std()) or 1.0
    design = np.stack([(x - middle) / spread, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (p - labels)) + np.array([0.02 * prior, 1e-6]) * beta
        hessian = (design * (weights * p * (1 - p))[:, None]).T @ design + np.diag([0.02 * prior, 1e-6])
        move = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        beta -= move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * middle / spread)


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    def make():
        model = sent.value
        seen = PartTable(model.parts) if model else None

        def step(batch):
            texts = batch.column("text")
            scores = 1 / (1 + np.exp(-np.clip(model.logits(seen, texts), -60, 60))) if model else np.zeros(len(texts))
            scores = scores.tolist()
            return {"doc_id": batch.column("doc_id"), "held_out": [fold(d) == 2 for d in batch.column("doc_id").to_pylist()], "score": scores, "predicted": [int(x >= threshold) for x in scores]}

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, held_out boolean, score double, predicted int")
