"""The words of a column of texts, found and hashed at once from the column's UTF-8 bytes: no word becomes an object."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of a word that are hashed eight at a time with those of all other words; longer words are hashed alone.
LONG_WORD = 64

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)

#: What each byte is for words between ASCII white space as they are written, for such words with A-Z as a-z, and for words of ASCII letters and
#: digits and anything beyond ASCII. What is no word is a space.
AS_WRITTEN = np.array([32 if b in (9, 10, 11, 12, 13) else b for b in range(256)], np.uint8)
BETWEEN_SPACES = np.array([32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTERS_AND_DIGITS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts, one after the other, and where each starts and the last one ends."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words(NamedTuple):
    """data: the bytes, with spaces for all that is no word. starts, ends: of each word there. hashes: of each word. at: the first word of each text, and the number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    at: np.ndarray

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def said(self, first: int, n: int) -> bytes:
        """n words from the first on, with a space between two."""
        return b" ".join(self.data[self.starts[first] : self.ends[first + n - 1]].tobytes().split())


def words_in(column: pa.Array, kinds: np.ndarray = BETWEEN_SPACES) -> Words:
    """The words of a column's texts; a null is an empty text."""
    data, at = text_bytes(column)
    data = kinds[data]
    inside = data != 32
    before = np.concatenate(([False], inside[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.concatenate((inside[1:], [False]))
    after[(at[1:] - 1)[at[1:] > at[:-1]]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    found = lengths.astype(np.uint64) * B
    left = np.arange(len(starts))
    for k in range(0, LONG_WORD, 8):
        left = left[lengths[left] > k]
        if not len(left):
            break
        own = eight[starts[left] + k] & _FIRST[np.minimum(lengths[left] - k, 8)]
        found[left] = mixed((found[left] ^ own) * A)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return Words(data, starts, ends, found, np.searchsorted(starts, at))
