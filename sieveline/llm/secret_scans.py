"""Secret scans: three base patterns, and assignment-aware lexing of names and literals.

The lexer reads `name op value` in source and configuration syntax (op one of = : := => ==, names bare, quoted or subscripted; values
quoted, bare or other names, also joined by +). Constants are propagated: a name that is given another name's value has that
name's literals. A literal is scored by how sensitive the names are that it reaches and by how random it looks; from `least` on its
span is added under the kind `literal`, unless a base span covers it.

Spans are in code points, end exclusive. A null text is empty. Repeated rows give repeated rows, a null doc_id stays null, an empty
table gives an empty result, other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame

from sieveline.llm.common import map_rows

KINDS = ("assign", "access", "hex", "literal")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)

# What may stand left of an operator (in the reversed text, from the operator on), and right of it. No repeat is bounded: possessive ones, and a run
# of bare characters that is measured once for all operators in it, keep the lexer linear on odd texts.
TARGET = re.compile(r"""\n?+[ \t]*+["'\]]{0,2}+([\w$.-]*[A-Za-z_$])""", re.ASCII)
OPERATOR = re.compile(r"(?:=>|:=|==|[=:])(?![=:])")
VALUE = re.compile(r"""[ \t]*+(?:(?P<q>["'`])(?P<quoted>[^"'`\n]++)(?P=q)|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?![\w+/=@-])|(?P<bare>(?=[^\s"'`,;()<>{}\[\]])))""", re.ASCII)
RUN = re.compile(r"""[^\s"'`,;()<>{}\[\]]++""", re.ASCII)
MORE = re.compile(r"[ \t]*+\+")

# Name parts and how sensitive they are, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "apitoken": 1.0,
    "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "signature": 0.4, "salt": 0.5, "otp": 0.6, "pin": 0.4,
    "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "authtoken": 1.0, "dsn": 0.6, "cookie": 0.5, "session": 0.4, "key": 0.3,
}
#: With `key` in the same name these make it sensitive.
KEY_KINDS = {"api", "private", "secret", "access", "auth", "encryption", "signing", "master", "account", "ssh", "hmac", "client", "service"}
# Literals that stand for a value rather than being one, as a whole and by how they begin.
STAND_INS = re.compile(r"(?i)changeme|change_me|example|sample|placeholder|none|null|nil|true|false|undefined|todo|test|dummy|redacted")
STAND_IN_STARTS = re.compile(r"(?i)your|\$\{|\{\{|<|env\b|os\.environ|process\.env")
NAME_LIKE = re.compile(r"[A-Za-z_$][\w$.-]*+", re.ASCII)


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", name)]
    joined = {"".join(pair) for pair in zip(parts, parts[1:], strict=False)}
    found = max((SENSITIVE.get(p, 0.0) for p in {*parts, *joined}), default=0.0)
    return 1.0 if "key" in parts and KEY_KINDS & set(parts) else found


class Characters:
    """The characters of literals that end at one place and lie in each other: each literal adds those in front of the one before it."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.logs = 0.0  # sum of c * log2(c)
        self.kinds = self.alone = 0
        self.spaced = False

    def add(self, piece: str) -> None:
        fresh = False
        for c, k in Counter(piece).items() if len(piece) > 20 else ((c, 1) for c in piece):
            n = self.counts.get(c, 0)
            fresh |= not n
            self.counts[c] = n + k
            self.logs += (n + k) * math.log2(n + k) - (n * math.log2(n) if n else 0.0)
        if fresh:
            own = "".join(self.counts)
            self.kinds = sum(bool(re.search(x, own)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]"))
            self.alone = set(own) <= {"x", "X"} or own in ("*", ".")
            self.spaced = any(c.isspace() for c in own)


def randomness(text: str, a: int = 0, b: int | None = None, known: Characters | None = None) -> float:
    """0 to 1 for the literal text[a:b], by Shannon entropy in bits a character, kinds of characters and length. known: its characters, where they are counted already."""
    b = len(text) if b is None else b
    n = b - a
    if known is None:
        known = Characters()
        known.add(text[a:b])
    if n < 6 or known.alone or text[a] == text[b - 1] == "%" or STAND_INS.fullmatch(text, a, min(b, a + 16)) and n <= 16 or STAND_IN_STARTS.match(text, a, b):
        return 0.0
    entropy = math.log2(n) - known.logs / n
    words = len(text[a:b].split()) if known.spaced else 1  # literals with spaces are quoted, and don't lie in each other
    return max(0.0, min(1.0, entropy / 4.0) * (0.55 + 0.15 * known.kinds) * min(1.0, n / 10) - 0.2 * (words - 1))


def _value(text: str, at: int, run: list[int]) -> tuple[str, int, int, int] | None:
    """(kind, start, end, where a joined value may start or -1) of the value at `at`. run: start, end and that place of the last bare run, kept for the next call."""
    found = VALUE.match(text, at)
    if not found:
        return None
    kind = found.lastgroup
    a, b = found.span(kind)
    if kind != "bare":
        more = MORE.match(text, found.end())
        return kind, a, b, more.end() if more else -1
    if not run[0] <= a < run[1]:
        b = RUN.match(text, a).end()
        more = MORE.match(text, b)
        run[:] = a, b, more.end() if more else -1
    return (kind, a, run[1], run[2]) if run[1] - a >= 6 else None


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, spans of literals, names whose values it takes) in text order."""
    found, flipped, run, joined_values = [], text[::-1], [0, 0, -1], {}
    for op in OPERATOR.finditer(text):
        left = TARGET.match(flipped, len(text) - op.start())
        if not left:
            continue
        spans, names = [], []
        value = _value(text, op.end(), run)
        while value:
            kind, a, b, more = value
            if kind == "name":
                names.append(text[a:b])
            if kind != "name" or more < 0:
                spans.append((a, b))
            if more < 0:
                break
            if more not in joined_values:
                joined_values[more] = _value(text, more, [0, 0, -1])
            value = joined_values[more]
        found.append((left[1][::-1], spans, names))
    return found


def literal_spans(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, in order."""
    if "=" not in text and ":" not in text:
        return []
    # An assignment is a node with its own literals and the nodes that its names had at that time; a name's value is its last node. So a
    # text of n assignments takes as many nodes and references as it names, however often values are joined to themselves.
    current: dict[str, int] = {}
    literals: list[list[tuple[int, int]]] = []
    sources: list[set[int]] = []
    weights: list[float] = []
    for name, spans, names in assignments(text):
        literals.append([s for s in spans if not NAME_LIKE.fullmatch(text, *s) or text[s[0] : s[1]] not in current])
        sources.append({current[other] for other in names if other in current})
        weights.append(sensitivity(name))
        short = name.rpartition(".")[2]
        current[name] = current[short] = len(weights) - 1
    reached: dict[tuple[int, int], float] = {}
    for at in range(len(weights) - 1, -1, -1):  # sources come before what takes their values
        if weight := weights[at]:
            for other in sources[at]:
                weights[other] = max(weights[other], weight)
            for span in literals[at]:
                reached[span] = max(reached.get(span, 0.0), weight)
    spans, known, last = [], Characters(), (0, 0)
    # Literals that end at one place lie in each other: their characters are counted once, and none is cut out whole.
    for a, b in sorted(reached, key=lambda s: (s[1], -s[0])):
        if b != last[1]:
            known, last = Characters(), (b, b)
        known.add(text[a : last[0]])
        last = a, b
        if reached[a, b] * randomness(text, a, b, known) >= least:
            spans.append((a, b))
    return sorted(spans)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(text: str, least: float = 0.5) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, as (start, end, kind) in order."""
    base = _in_order(base_spans(text))
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    more = [(a, b, "literal") for a, b in literal_spans(text, least) if not (at := bisect_right(starts, a)) or ends[at - 1] < b]
    return base, _in_order(base + more)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, mask: str = "[SECRET]", least: float = 0.5) -> str:
    """text with each run of overlapping spans replaced by mask."""
    out, at = [], 0
    for a, b, _ in find_secrets(text, least)[1]:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The counts of base matches by kind, the digest of the base spans and all spans, a row for each row of docs."""

    def make():
        def step(batch):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = find_secrets(text or "", least)
                n = Counter(kind for _, _, kind in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return {"doc_id": batch.column("doc_id")} | dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), map(list, zip(*rows, strict=True)), strict=True))

        return step

    return map_rows(docs, ["doc_id", "text"], make, SCHEMA)


def redacted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, with doc_id, text, lang, source and n_chars only, and secrets masked in text."""

    def make():
        def step(batch):
            texts = [t and redact(t, least=least) for t in batch.column("text").to_pylist()]
            return {c: batch.column(c) for c in ("doc_id", "lang", "source")} | {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}

        return step

    return map_rows(docs, ["doc_id", "text", "lang", "source"], make, "doc_id long, text string, lang string, source string, n_chars long")
