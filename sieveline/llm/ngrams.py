"""Hashed character n-grams of many words at once, and a worker's table of figures of the parts that it has seen."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from sieveline.llm.words import AS_WRITTEN, words_in

#: Words whose n-grams are in memory at once, and characters of them.
AT_ONCE = 8_000
CHARS_AT_ONCE = 100_000

_M = np.uint32(0x01000193)


def hashed_ngrams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each n-gram of the words, with a mark before and after a word and of each whole word, in word order."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    owners, found = [], []

    def add(owner: np.ndarray, hashes: np.ndarray, salt: int) -> None:
        owners.append(owner)
        found.append(_bucket(hashes, salt, buckets))

    rolled = codes.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            rolled = rolled[:-1] * _M + codes[n - 1 :]
        if n in sizes:
            inside = word[: len(rolled)] == word[n - 1 :]
            add(word[: len(rolled)][inside], rolled[inside], n)
    if whole:
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - starts[word]
        powers = np.cumprod(np.concatenate(([1], np.full(int(lengths.max()) - 1, 0x01000193))).astype(np.uint32), dtype=np.uint32)
        add(np.arange(len(words)), np.add.reduceat(codes * powers[place], starts, dtype=np.uint32), 99)
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def ngram_blocks(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same as hashed_ngrams in blocks of bounded size, in word order: of several words, or of a part of one word however long it is."""
    begin, chars = 0, 0
    for i, word in enumerate(words):
        if i > begin and chars + len(word) > CHARS_AT_ONCE:
            owner, bucket = hashed_ngrams(words[begin:i], sizes, buckets, whole)
            yield begin + owner, bucket
            begin, chars = i, 0
        if len(word) > CHARS_AT_ONCE:
            for bucket in _of_long_word(word, sizes, buckets, whole):
                if len(bucket):
                    yield np.full(len(bucket), i), bucket
            begin, chars = i + 1, 0
        else:
            chars += len(word)
    if begin < len(words):
        owner, bucket = hashed_ngrams(words[begin:], sizes, buckets, whole)
        yield begin + owner, bucket


def _of_long_word(word: str, sizes: tuple[int, ...], buckets: int, whole: bool) -> Iterator[np.ndarray]:
    """Buckets of a word's n-grams, by stretches of the word that overlap by what an n-gram needs; those of the whole word last."""
    codes, total, power = f"<{word}>", np.uint32(0), np.uint32(1)
    powers = np.cumprod(np.concatenate(([1], np.full(CHARS_AT_ONCE, int(_M)))).astype(np.uint32), dtype=np.uint32)
    longest = max(sizes)
    for a in range(0, len(codes), CHARS_AT_ONCE):
        own = np.frombuffer(codes[a : a + CHARS_AT_ONCE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = min(CHARS_AT_ONCE, len(codes) - a)
        rolled = own.copy()
        for n in range(1, longest + 1):
            if n > 1:
                rolled = rolled[:-1] * _M + own[n - 1 :]
            if n in sizes:
                yield _bucket(rolled[:inside], n, buckets)
        with np.errstate(over="ignore"):
            total = total + power * np.add.reduce(own[:inside] * powers[:inside], dtype=np.uint32)
            power = power * powers[CHARS_AT_ONCE]
    if whole:
        yield _bucket(np.array([total], np.uint32), 99, buckets)


def _bucket(hashes: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    h = hashes * np.uint32(0x9E3779B1) + np.uint32(salt)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h % np.uint32(buckets)).astype(np.int64)


class PartTable:
    """Figures of the parts of texts between ASCII white space. Parts that are new in a batch get theirs together; when there are too many, those that were not met
    again go."""

    def __init__(self, figures: Callable[[list[str]], np.ndarray], most: int = 200_000) -> None:
        self.figures, self.most = figures, most
        self.index: dict[int, int] = {}
        self.rows = figures([])
        self.used = np.zeros(0, np.int32)

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers in `rows` of each text's parts; they hold until the next call."""
        if len(self.index) > self.most:
            self._forget()
        words = words_in(texts, AS_WRITTEN)
        hashes, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        numbers = np.fromiter(map(self.index.get, hashes.tolist(), repeat(-1)), np.int64, len(hashes))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = np.arange(len(fresh)) + len(self.rows)
            self.index.update(zip(hashes[fresh].tolist(), numbers[fresh].tolist(), strict=True))
            data, place = words.data.tobytes(), first[fresh]
            parts = [data[a:b].decode(errors="replace") for a, b in zip(words.starts[place].tolist(), words.ends[place].tolist(), strict=True)]
            self.rows = np.concatenate([self.rows, *(self.figures(parts[a : a + AT_ONCE]) for a in range(0, len(parts), AT_ONCE))])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int32)])
        self.used[numbers] += 1
        return np.split(numbers[back], words.at[1:-1])

    def _forget(self) -> None:
        """Parts that only one batch had go; of the others no more than half of `most` stay, the most frequent ones."""
        bound = max(2, int(np.partition(self.used, -(self.most // 2))[-(self.most // 2)]) + 1)
        kept = np.flatnonzero(self.used >= bound)
        places = np.full(len(self.rows), -1)
        places[kept] = np.arange(len(kept))
        self.index = {h: int(n) for h, i in self.index.items() if (n := places[i]) >= 0}
        self.rows, self.used = self.rows[kept], np.zeros(len(kept), np.int32)
