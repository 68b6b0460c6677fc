"""Documents of odd shapes, for every operator."""

import random

WORDS = "stone river lantern copper winter harbor meadow thunder velvet orchard pepper marble falcon timber saddle ribbon".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


LONG = prose(1, 30_000)

#: doc_id, text, lang, source; extra columns clash with names that operators use.
ROWS = [
    (1, prose(2, 80), "en", "a"), (2, prose(2, 80), "en", "a"), (3, prose(2, 79) + " changed", "en", "b"), (4, "", "en", "b"), (5, None, None, None), (6, "   \n\t ", "de", "c"),
    (7, "word", "de", "c"), (8, "WORD", "de", "c"), (9, LONG, "en", "a"), (10, LONG, "fr", "a"), (11, prose(3, 60), "en", "a"), (11, prose(3, 60), "en", "a"), (None, prose(3, 60), "en", "a"),
    (12, "é ü  ß\n\n中文 字 <|endoftext|> ‌ \x85x", "fr", "d"), (13, "same line\nsame line\n\nsame line", "en", "d"), (14, "!!! ??? 123", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, n_words long, rank int, host string, score double, `first` string"


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0, 0, 0, "h", 0.0, "f") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
