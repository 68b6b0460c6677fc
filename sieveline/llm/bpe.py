"""Exact byte-level BPE ids of a tokenizers file, faster than the library on running text.

A text of code points where the regular-expression engines surely agree, without a special token's string, is cut and merged by rank as a whole,
and nothing of it is remembered. In other texts, three facts make it exact. (1) A space that a non-space follows always starts a new pre-token, so a text may be
split before such spaces. A part that starts with two white-space characters breaks this, and then the library takes
the whole text. (2) A pre-token that the library itself encodes alone as one token has that token: this is
proved once for every vocabulary string. (3) The other pre-tokens are merged by rank; a part outside the range of code points, or with a special token's string,
goes to the library.
"""

from __future__ import annotations

import json
import re
import struct
from array import array

from sieveline.llm.common import Remembered, held

#: Last code point of the range in which classes of letters, numbers and white space are taken from Python's tables.
SAFE_END = 0x24F
#: Entries of a worker's caches of space-led parts and of pre-tokens, of texts that aren't merged as a whole.
PARTS, PIECES = 100_000, 50_000
#: A text with so much white space in a row goes to the library: cutting it takes steps back for each character of a run.
LONG_SPACE = 10_000

# Fixed value: the pre-token pattern of byte-level BPE files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_ONE = struct.Struct("<I").pack
_long_space = re.compile(rf"\s{{{LONG_SPACE}}}").search

#: The same for a part of printable ASCII with the space before it.
_ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+").findall


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, to the byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(tokenizer_json: str) -> dict[str, int]:
    """Vocabulary strings (as text) that the library encodes alone as just their own token, with its id."""
    from tokenizers import Tokenizer

    library, alphabet = Tokenizer.from_str(tokenizer_json), _byte_alphabet()
    texts = []
    for token in json.loads(tokenizer_json)["model"]["vocab"]:
        try:
            texts.append(bytes(alphabet[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    found = library.encode_batch(texts, add_special_tokens=False)
    return {t: e.ids[0] for t, e in zip(texts, found, strict=True) if len(e.ids) == 1}


class Bpe:
    """Ids and counts of whole texts; keep one in a worker process (see `worker_bpe`)."""

    def __init__(self, tokenizer_json: str, whole: dict[str, int]) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.whole = Tokenizer.from_str(tokenizer_json), whole
        spec, alphabet = json.loads(tokenizer_json), _byte_alphabet()
        # Merging by rank needs ids in the order of the merges, and this pre-tokenizer with no normalizer; else the library takes all.
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"].get(a + b) for a, b in merges]
        pre = spec["pre_tokenizer"] or {}
        self.fast = None not in order and order == sorted(order) and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(set(order)) == len(order)
        special = [t["content"] for t in spec["added_tokens"]]
        for text in special:
            ranks.pop(text.encode(), None)
        self.fast = self.fast and not any(" " in t or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"] if isinstance(t, dict))
        odd = "|".join([rf"[^\x00-{chr(SAFE_END)}]", *map(re.escape, special)])
        self.odd = re.compile(odd).search
        self.pieces_of = regex.compile(PRE_TOKEN).findall
        self.merge = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if self.fast else None
        self.unproved = {bytes(alphabet[c] for c in t).decode(errors="replace") for t in spec["model"]["vocab"] if all(c in alphabet for c in t)} - whole.keys()
        self.plain = not any(t.isalpha() for t in special)
        self.mergeable = all(map(self.odd, self.unproved))
        self.piece_ids = Remembered(self._piece_ids, PIECES)
        self.part_ids = Remembered(self._part_ids, PARTS)
        self.part_counts = Remembered(self._part_count, PARTS)

    def _library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece_ids(self, piece: str) -> bytes:
        token = self.whole.get(piece)
        if token is not None:
            return _ONE(token)
        if piece in self.unproved:
            return self._library(piece)
        return array("I", self.merge(piece)).tobytes()

    def _part(self, text: str) -> bytes:
        """Packed ids of a text's beginning or, with the space before it, of a part."""
        if self.odd(text):
            return self._library(text)
        return b"".join(map(self.piece_ids.__getitem__, self.pieces_of(text)))

    def _part_ids(self, part: str) -> bytes | None:
        """Packed ids of a part after a space; None where its border isn't surely one of a pre-token."""
        text = " " + part
        if part.isascii() and part.isprintable():
            if self.plain and part.isalpha():  # one pre-token
                return self._piece_ids(text)
            if part and not self.odd(text):
                return b"".join(map(self.piece_ids.__getitem__, _ascii_pieces(text)))
        return None if not part or part[0].isspace() else self._part(text)

    def _part_count(self, part: str) -> int | None:
        text = " " + part
        if self.plain and part.isascii() and part.isalpha() and text not in self.unproved:
            return 1 if text in self.whole else len(self.merge(text))
        packed = self._part_ids(part)
        return None if packed is None else len(packed) // 4

    def _is_plain(self, text: str) -> bool:
        """Whether the text is merged as a whole: no unproved string is within the range either."""
        return self.mergeable and not self.odd(text)

    def packed(self, text: str) -> bytes:
        """The text's ids, each as 4 bytes, little-endian."""
        if not self.fast or (len(text) >= LONG_SPACE and _long_space(text)):
            return self._library(text)
        if self._is_plain(text):
            return array("I", self.merge(text)).tobytes()
        first, *rest = text.split(" ")
        try:
            return self._part(first) + b"".join(map(self.part_ids.__getitem__, rest))
        except TypeError:  # a None among the parts
            return self._library(text)

    def count(self, text: str) -> int:
        if not self.fast or (len(text) >= LONG_SPACE and _long_space(text)):
            return len(self._library(text)) // 4
        if self._is_plain(text):
            return len(self.merge(text))
        first, *rest = text.split(" ")
        try:
            return len(self._part(first)) // 4 + sum(map(self.part_counts.__getitem__, rest))
        except TypeError:
            return len(self._library(text)) // 4


def worker_bpe(tokenizer_json: str, whole: dict[str, int]) -> Bpe:
    """One Bpe for each file in a worker process, so that later tasks of the operator find its caches filled."""
    return held(("bpe", hash(tokenizer_json)), lambda: Bpe(tokenizer_json, whole))


def broadcast_bpe(spark, path: str):
    """The file's text and the proved strings, sent to the executors; both are bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((text, prove_whole_tokens(text)))
