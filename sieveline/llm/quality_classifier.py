"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One set of hashed-text weights is shared by all grades; ordered thresholds cut its score: P(grade above the k-th) = logistic(score - threshold k). Grades are
any integers, as many as there are in the sample; the expected grade is in their values.

The model is fitted to a bounded sample of labelled ids (`max_rows`, by a hash of doc_id) that aren't held out. Of several labels of a doc_id the largest
counts, of several rows of a sampled doc_id one, so the sample is bounded however often they repeat. Rows of labels with null doc_id or grade aren't learnt from.

Null texts are empty, and empty texts get what the thresholds alone say. Repeated rows give repeated rows, texts that tie get the same grade, a null doc_id stays null and counts as held out, an empty
table gives an empty result. Where the labels have one grade all get it; without labelled rows the expected grade is 0 and nothing is selected. Other columns are not read.
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
from sieveline.llm.ngrams import PartTable

BUCKETS, MAX_ROWS = 1 << 16, 4_000
#: What a text's shares of words are multiplied with.
SCALE = 20


#: Words as the scoring splits them.
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS


def thresholds(gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first one, then positive gaps as logarithms."""
    return np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:]))))


def loss_and_gradients(weights: np.ndarray, gaps: np.ndarray, features: tuple, grades: np.ndarray, decay: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean over texts of the summed logistic losses of `grade above the k-th`, with its gradients. features: (text, bucket, value)."""
    rows, columns, values = features
    n = len(grades)
    over = grades[:, None] > np.arange(len(gaps))[None]
    z = np.bincount(rows, weights=weights[columns] * values, minlength=n)[:, None] - thresholds(gaps)
    loss = float((np.logaddexp(0, z) - over * z).sum() / n + decay / 2 * (weights**2).sum())
    off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - over) / n
    tail = -np.cumsum(off.sum(axis=0)[::-1])[::-1]
    by_weight = np.bincount(columns, weights=off.sum(axis=1)[rows] * values, minlength=len(weights)) + decay * weights
    return loss, by_weight, np.concatenate((tail[:1], tail[1:] * np.exp(gaps[1:])))


def train(features: tuple, grades: np.ndarray, k: int, steps: int = 100, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam. grades: 0 to k - 1."""
    params = [np.zeros(BUCKETS), np.zeros(k - 1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        _, *grads = loss_and_gradients(*params, features, grades)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[0], thresholds(params[1])


class Model:
    """levels: the grades in order; weights and cuts as of train."""

    def __init__(self, levels: list[int], weights: np.ndarray, cuts: np.ndarray) -> None:
        self.levels, self.weights, self.cuts = levels, weights, cuts

    def table(self) -> PartTable:
        return PartTable(lambda parts: self.weights[np.array([bucket(p) for p in parts], np.int64)])

    def above(self, table: PartTable, texts: pa.Array) -> np.ndarray:
        """P(grade above each level but the last), by text."""
        scores = np.array([SCALE * table.rows[at].mean() if len(at) else 0.0 for at in table.numbers(texts)])
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts, -60, 60)))

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.levels[0] + above @ np.diff(self.levels)

    def tail(self, above: np.ndarray, least: int) -> np.ndarray:
        """P(grade of least or more)."""
        lower = sum(level < least for level in self.levels)
        return np.ones(len(above)) if not lower else np.zeros(len(above)) if lower == len(self.levels) else above[:, lower - 1]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, grade_column: str = "quality") -> Model | None:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(grade_column).isNotNull() & (fold_column() != 2)).groupBy("doc_id").agg(F.max(grade_column).alias("grade"))
    share = int(min(1.0, max_rows / max(1, known.count())) * (1 << 30))
    grades = {r["doc_id"]: r["grade"] for r in known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < share).collect()}
    if not grades:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(grades))

    def make():
        def step(batch):
            own = [(d, sorted(Counter(map(bucket, WORDS(t or ""))).items())) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if d in sent.value]
            return {"doc_id": [d for d, _ in own], "buckets": [[b for b, _ in c] for _, c in own], "n": [[n for _, n in c] for _, c in own]} if own else None

        return step

    # A row for each sampled id, whatever the number of rows that have it.
    found = map_rows(docs, ["doc_id", "text"], make, "doc_id long, buckets array<int>, n array<int>").groupBy("doc_id").agg(F.min(F.struct("buckets", "n")).alias("x")).select("doc_id", "x.*").toArrow().to_pylist()
    if not found:
        return None
    found.sort(key=lambda r: r["doc_id"])
    own = np.array([grades[r["doc_id"]] for r in found])
    levels = sorted(set(own.tolist()))
    if len(levels) < 2:
        return Model(levels, np.zeros(BUCKETS), np.zeros(0))
    rows = np.repeat(np.arange(len(found)), [len(r["buckets"]) for r in found])
    columns = np.array([b for r in found for b in r["buckets"]], np.int64)
    n = np.array([x for r in found for x in r["n"]], float)
    total = np.maximum(1, np.bincount(rows, weights=n, minlength=len(found)))
    return Model(levels, *train((rows, columns, n / total[rows] * SCALE), np.searchsorted(levels, own), len(levels)))


def grade(docs: DataFrame, labels: DataFrame, least: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, expected_grade, p_tail (probability of grade `least` or more), selected (p_tail of a half or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    def make():
        model = sent.value
        seen = model.table() if model else None

        def step(batch):
            if model:
                above = model.above(seen, batch.column("text"))
                expected, tail = model.expected(above), model.tail(above, least)
            else:
                expected = tail = np.zeros(batch.num_rows)
            return {"doc_id": batch.column("doc_id"), "held_out": [fold(d) == 2 for d in batch.column("doc_id").to_pylist()], "expected_grade": expected, "p_tail": tail, "selected": tail >= 0.5}

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, held_out boolean, expected_grade double, p_tail double, selected boolean")
