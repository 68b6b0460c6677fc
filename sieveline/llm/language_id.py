"""Language identification of whole texts, words and spans.

Each word's script narrows the languages that it may be in; character n-grams score those. The best labelling of a text's words under
a penalty for each switch (Viterbi) cuts it into spans of one language; the language with the most letters is the text's. A text
whose best labelling provably has one language, as no stretch of words gains more than a switch costs, needs no full Viterbi pass.

The model is fitted to a bounded sample of labelled rows (`max_rows`, chosen by a hash of doc_id and text). Null texts and texts without a letter
are `und`, score 0. Rows with a null label or one of the rarest (MOST_LABELS) are not learnt from. Without any labelled row all texts are `und`. Repeated rows give
repeated rows; a null doc_id stays null and counts as held out; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import fold, fold_column, keep_batches, map_rows
from sieveline.llm.ngrams import CHARS_AT_ONCE, PartTable, ngram_blocks

BUCKETS = 1 << 16
#: Labelled rows that the model is fitted to, about.
MAX_ROWS = 20_000
SWITCH_PENALTY = 12.0
#: Labels that fewer than one in so many labelled rows have aren't learnt: so the model has a set size, however odd the labels are.
MOST_LABELS = 1_000

# First code points of ranges, and their script; scripts not named here count as "other".
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = [start for start, _ in SCRIPT_RANGES]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_SCRIPT_NUMBERS = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


def script_of(c: str) -> str:
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(c)) - 1][1]


_ascii_letters = re.compile("[a-z]+").findall


def main_scripts(words: list[str]) -> np.ndarray:
    """The number in SCRIPTS of the script that most of each word's letters have; none of the words is empty."""
    text, ends = "".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    counts = np.zeros((len(words), len(SCRIPTS)), np.int64)
    for a in range(0, len(text), CHARS_AT_ONCE):
        codes = np.frombuffer(text[a : a + CHARS_AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.searchsorted(ends, np.arange(a, a + len(codes)), "right")
        script = _SCRIPT_NUMBERS[np.searchsorted(_STARTS, codes, "right") - 1]
        first, last = int(owner[0]), int(owner[-1]) + 1
        counts[first:last] += np.bincount((owner - first) * len(SCRIPTS) + script, minlength=(last - first) * len(SCRIPTS)).reshape(last - first, len(SCRIPTS))
    return counts.argmax(axis=1)


def letters_of(chunk: str) -> list[str]:
    """The runs of letters in lower case."""
    if chunk.isalpha():
        return [chunk.lower()]
    if chunk.isascii():
        return _ascii_letters(chunk.lower())
    return "".join(c if c.isalpha() else " " for c in chunk).lower().split()


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, bucket) of the words' n-grams of 1 to 4 characters and of the words themselves, in blocks."""
    return ngram_blocks(words, (1, 2, 3, 4), BUCKETS)


def split_letters(chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all chunks, and the number of each word's chunk."""
    words, owner = [], []
    for i, chunk in enumerate(chunks):
        own = letters_of(chunk)
        words += own
        owner += [i] * len(own)
    return words, np.array(owner, np.int64)


class Model:
    """Log-probabilities of buckets by language, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        """counts: (lang, bucket, n); buckets from BUCKETS on count letters of a script."""
        self.langs = sorted({lang for lang, _, _ in counts})
        n = np.zeros((BUCKETS + len(SCRIPTS), max(1, len(self.langs))))
        for lang, bucket, k in counts:
            n[bucket, self.langs.index(lang)] += k
        own = n[:BUCKETS] + 0.5
        self.logs = np.log(own / own.sum(axis=0)).astype(np.float32)
        letters = n[BUCKETS:]
        share = letters / np.maximum(1.0, letters.sum(axis=0))
        self.candidates = share >= 0.01  # by script and language

    def words(self, words: list[str]) -> np.ndarray:
        """Scores by word and language; languages that never use the word's script get none of its evidence and a fixed loss."""
        scores = np.zeros((len(words), len(self.langs)), np.float32)
        if not words or not self.langs:
            return scores
        for owner, bucket in grams(words):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            scores[owner[first]] += np.add.reduceat(self.logs[bucket], first, axis=0) / 3.0
        narrowed = self.candidates[main_scripts(words)]
        scores -= np.where(narrowed, scores, -np.inf).max(axis=1, initial=-1e30)[:, None]
        scores = np.where(narrowed, np.maximum(scores, -20.0), -30.0)
        return np.where(narrowed.any(axis=1)[:, None], scores, 0.0).astype(np.float32)

    def parts(self, chunks: list[str]) -> np.ndarray:
        """Scores by language, and letters, of each chunk."""
        out = np.zeros((len(chunks), len(self.langs) + 1), np.float32)
        words, owner = split_letters(chunks)
        np.add.at(out[:, :-1], owner, self.words(words))
        np.add.at(out[:, -1], owner, np.fromiter(map(len, words), np.float32, len(words)))
        return out


class Labeller:
    """Languages of texts; remembers the scores of the space-separated parts that it has seen."""

    def __init__(self, model: Model, penalty: float) -> None:
        self.model, self.penalty, self.table = model, penalty, PartTable(model.parts)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word."""
        best = int(scores.sum(axis=0).argmax())
        gain = scores.max(axis=1) - scores[:, best]
        ahead = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
        if len(ahead) and (ahead[-1] <= self.penalty or self._calm(scores, best)):
            return np.full(len(scores), best)
        return viterbi(scores, self.penalty)

    def _calm(self, scores: np.ndarray, best: int) -> bool:
        """Whether no stretch of words scores better than `best` by more than a switch, whatever languages it is given."""
        rest = np.delete(scores, best, axis=1)
        if not rest.shape[1]:
            return True
        total = np.concatenate(([0.0], np.cumsum(rest.max(axis=1) - scores[:, best], dtype=np.float64)))
        return float((total - np.minimum.accumulate(total)).max()) <= self.penalty

    def __call__(self, texts: pa.Array) -> list[tuple[str, float]]:
        """Language and score of each text."""
        numbers = self.table.numbers(texts)
        return [self._one(self.table.rows[at]) for at in numbers]

    def _one(self, rows: np.ndarray) -> tuple[str, float]:
        rows = rows[rows[:, -1] > 0]
        if not len(rows) or not self.model.langs:
            return "und", 0.0
        scores, letters = rows[:, :-1], rows[:, -1]
        mass = np.bincount(self.path(scores), weights=letters, minlength=len(self.model.langs))
        total = scores.sum(axis=0, dtype=np.float64)
        best = int(np.lexsort((-total, -mass))[0])  # most letters, then the better score
        # Its share of the letters, times its probability among the languages for the text as a whole (a half at least).
        odds = np.exp(np.clip(total - total[best], -50, 50)).sum()
        return self.model.langs[best], float(mass[best] / mass.sum() / min(2.0, odds))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end word, language) of the text's spans; words are its space-separated parts."""
        (at,) = self.table.numbers(pa.array([text]))
        rows = self.table.rows[at]
        path = self.path(rows[:, :-1]) if len(rows) else np.zeros(0, int)
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(a, b, self.model.langs[path[a]]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of greatest score, less `penalty` for each change of label."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    own = list(range(k))
    value = scores[0].tolist()
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(own, key=value.__getitem__)
        limit = value[top] - penalty
        back[t] = [j if value[j] >= limit else top for j in own]
        value = [max(value[j], limit) + row[j] for j in own]
    path = np.zeros(n, np.int64)
    path[-1] = max(own, key=value.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of the rows of docs that have a label and aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & (fold_column() != 2))
    n = labelled.count()
    often = labelled.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") * MOST_LABELS >= n)  # MOST_LABELS rows at most
    labelled = labelled.join(F.broadcast(often.select("lang")), "lang", "left_semi")
    share = int(min(1.0, max_rows / max(1, n)) * (1 << 30))
    # By id and text, so that neither a repeated id nor a repeated text is all of the sample or none; what is collected are sums by language and bucket.
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(1 << 30)) < share)

    def make():
        counts: dict[str, Counter] = {}

        def step(batch):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    counts.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, counts.values())) > 100_000:
                return last()
            return None

        def last():
            columns: dict[str, list] = {"lang": [], "bucket": [], "n": []}
            for lang, chunks in counts.items():
                words, owner = split_letters(list(chunks))
                times = np.fromiter(chunks.values(), np.int64, len(chunks))[owner] if words else np.zeros(0, np.int64)
                total = np.zeros(BUCKETS)
                for word, bucket in grams(words):
                    total += np.bincount(bucket, weights=times[word], minlength=BUCKETS)
                letters: Counter = Counter()
                for w, k in zip(words, times.tolist(), strict=True):
                    if w.isascii():
                        letters["latin"] += k * len(w)
                    else:
                        for c in w:
                            letters[script_of(c)] += k
                some = np.flatnonzero(total).tolist()
                columns["lang"] += [lang] * (len(some) + len(letters))
                columns["bucket"] += [*some, *(BUCKETS + SCRIPTS.index(x) for x in letters)]
                columns["n"] += [*map(int, total[some]), *letters.values()]
            counts.clear()
            return columns if columns["n"] else None

        step.last = last
        return step

    # As many rows at most as languages times buckets.
    summed = map_rows(sample, ["doc_id", "lang", "text"], make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([(r["lang"], r["bucket"], r["n"]) for r in summed.toLocalIterator()])


def identify(docs: DataFrame, max_rows: int = MAX_ROWS, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, max_rows))

    def make():
        label = Labeller(sent.value, penalty)

        def step(batch):
            found = label(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "held_out": [fold(d) == 2 for d in batch.column("doc_id").to_pylist()], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.25, max_rows: int = MAX_ROWS, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of docs whose texts have a language with a score of `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, max_rows))

    def make():
        label = Labeller(sent.value, penalty)
        return lambda batch: [lang != "und" and score >= least for lang, score in label(batch.column("text"))]

    return keep_batches(docs, make)
