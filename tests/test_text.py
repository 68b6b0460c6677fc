import hashlib
import random
import string

import pytest

from sieveline import constants as C
from sieveline.functions import text as T


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def each(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def kind(c):
    return "upper" if c in string.ascii_uppercase else "lower" if c in string.ascii_lowercase else "digit" if c in string.digits else ""


def plain_parts(name):
    """Character by character: a part ends where the kind changes, but one capital stays with the small letters after it."""
    parts, at = [], 0
    while at < len(name):
        end = at
        while end < len(name) and kind(name[end]) == kind(name[at]):
            end += 1
        if kind(name[at]) == "upper" and end < len(name) and kind(name[end]) == "lower":
            if end - at > 1:
                parts.append(name[at : end - 1])
                at = end - 1
            while end < len(name) and kind(name[end]) == "lower":
                end += 1
        if kind(name[at]):
            parts.append(name[at:end])
        at = end
    return [p.lower() for p in parts]


def plain_tokens(text):
    words, own = [], ""
    for c in text + " ":
        starts = c.isascii() and (c.isalpha() or c == "_")
        if starts and not own.isdigit() or c in string.digits and c and own:
            own += c
        elif c in string.digits and c:
            own = c
        else:
            words.append(own)
            own = c if starts else ""
    out = []
    for word in filter(None, words):
        parts = plain_parts(word)
        out += [word.lower(), *parts] if len(parts) > 1 else parts
    return [t for t in out if len(t) > 1 and not t.isdigit() and t not in C.C_KEYWORDS and t not in C.STOP_WORDS]


def names(n, alphabet="abXYZ_19"):
    draw = random.Random(n)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 12))) for _ in range(n)] + ["", "_", "A", "Ab", "ABc", "aBC", "a1B", "XML2HTMLPage", "é_x"]


def test_identifiers_are_split_as_plainly(spark):
    own = names(500)
    assert each(spark, own, T.split_identifier("x")) == [plain_parts(n) for n in own]


def test_tokens_are_the_plain_ones(spark):
    draw = random.Random(3)
    pieces = [*names(40), "int", "return", "while", "the", "ring", "Ring", "x", "42", "7up", " ", "(", ";", "->", "\n", "é", "."]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " "]) for _ in range(draw.randint(0, 25))) for _ in range(300)]
    assert each(spark, texts, T.tokenize("x")) == [plain_tokens(t) for t in texts]


@pytest.mark.parametrize(("comment", "query"), [("ring grows", None), ("it is of the", None), ("see the LICENSE of this ring", None), ("Copyrights of all ring makers", None), (" keeps  the\tring\nin order ", "keeps the ring in order"), ("ring " * 200, " ".join(["ring"] * C.MAX_QUERY_WORDS))])
def test_query_text(spark, comment, query):
    assert one(spark, comment, T.query_text("x")) == query


def test_code_forms(spark):
    code = "ring push (src/ring.c)\nlong  n=2;"
    assert one(spark, code, T.code_body("x")) == "long  n=2;"
    assert one(spark, code, T.normalise_code("x")) == "long n = 2 ;"
    assert one(spark, code, T.code_hash("x")) == hashlib.sha1(b"long n = 2 ;").hexdigest()


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles_are_the_plain_sets(spark, k):
    """And as many hashed ones, which are equal where the others are."""
    draw = random.Random(k)
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 12))) for _ in range(200)]
    plain = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in map(str.split, texts)]
    said, hashed = each(spark, texts, T.comment_shingles("x", k)), each(spark, texts, T.hashed_comment_shingles("x", k))
    assert [{tuple(s.split()) for s in own} for own in said] == plain and [len(own) for own in said] == [len(own) for own in plain]
    for own, numbers in zip(plain, hashed, strict=True):
        assert len(set(numbers)) == len(numbers) == len(own)
    for a, x in zip(plain[:40], hashed[:40], strict=True):
        for b, y in zip(plain[:40], hashed[:40], strict=True):
            assert len(a & b) == len(set(x) & set(y))


def test_split_is_the_hash_of_the_file(spark):
    rows = [("r", f"f{i}") for i in range(200)]
    found = [r[0] for r in spark.createDataFrame(rows, "r string, f string").select(T.split_of("r", "f")).collect()]
    assert found == ["val" if int(hashlib.sha1("/".join(r).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.1 else "train" for r in rows]
