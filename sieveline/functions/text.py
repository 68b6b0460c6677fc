"""Text functions as expressions: column in, column out, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import constants as C


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, use) -> Column:
    """use(x) with x computed once: what stands outside a lambda is computed anew for each element inside it, a lambda's variable isn't."""
    return F.element_at(F.transform(F.array(_col(x)), use), 1)


def split_identifier(x) -> Column:
    """Lower-case parts of an identifier: at underscores, case changes, acronyms and digits."""
    return F.transform(F.regexp_extract_all(_col(x), F.lit(C.CAMEL), F.lit(0)), F.lower)


def tokenize(x) -> Column:
    """Search tokens: each word's parts, with the whole word before them when it has several."""
    dropped = sorted({*C.C_KEYWORDS, *C.STOP_WORDS})

    def parts(word: Column) -> Column:
        return let(split_identifier(word), lambda own: F.when(F.size(own) > 1, F.concat(F.array(F.lower(word)), own)).otherwise(own))

    words = F.regexp_extract_all(_col(x), F.lit(C.WORD), F.lit(0))
    return F.filter(F.flatten(F.transform(words, parts)), lambda t: (F.length(t) > 1) & ~t.isin(dropped) & ~t.rlike("^[0-9]+$"))


def squeeze(x) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def words(x) -> Column:
    """Words between white space."""
    return F.filter(F.split(_col(x), r"(?U)\s+"), lambda w: w != "")


def unit_text(comment_raw, body, include_comment: bool = True) -> Column:
    if not include_comment:
        return _col(body)
    return F.when(_col(comment_raw) != "", F.concat_ws("\n", _col(comment_raw), _col(body))).otherwise(_col(body))


def lexical_text(file, text) -> Column:
    return F.concat_ws(" ", _col(file), _col(text))


def dense_text(name, file, text) -> Column:
    return F.concat(F.array_join(split_identifier(name), " "), F.lit(" ("), _col(file), F.lit(")\n"), _col(text))


def query_text(comment) -> Column:
    """The query that a comment gives: null when it is too short, has no tokens or is a licence note; cut to its first words."""
    low = F.lower(_col(comment))
    usable = (F.size(tokenize(comment)) > 0) & ~low.contains("copyright") & ~low.contains("license")
    return let(words(comment), lambda own: F.when((F.size(own) >= C.MIN_QUERY_WORDS) & usable, F.array_join(F.slice(own, 1, C.MAX_QUERY_WORDS), " ")))


def clean_comment(raw) -> Column:
    """Plain prose of a comment: no markers, no decoration, no rules; on one line."""
    lines = F.split(_col(raw), "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")

    def plain(line: Column) -> Column:
        line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        line = F.regexp_replace(line, "^//", "")
        line = F.replace(F.replace(line, F.lit("/*"), F.lit(" ")), F.lit("*/"), F.lit(" "))
        line = F.regexp_replace(line, r"(?U)^[\s/*!<-]*", "")
        line = F.regexp_replace(line, r"(?U)\s+$", "")
        return F.regexp_replace(F.regexp_replace(line, r"\*+$", ""), r"(?U)^\s+|\s+$", "")

    return squeeze(F.array_join(F.filter(F.transform(lines, plain), lambda x: ~x.rlike(r"(?U)^[\s=*#~_+-]*$")), " "))


def code_body(code) -> Column:
    """The code without the header line that dense_text puts in front."""
    head = F.substring_index(_col(code), "\n", 1)
    return F.when(_col(code).contains("\n") & head.endswith(")"), F.substring(_col(code), F.length(head) + 2, F.length(_col(code)))).otherwise(_col(code))


def code_tokens(code) -> Column:
    return F.regexp_extract_all(code_body(code), F.lit(C.CODE_TOKEN), F.lit(0))


def normalise_code(code) -> Column:
    return F.array_join(code_tokens(code), " ")


def code_hash(code) -> Column:
    return F.sha1(normalise_code(code))


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens; one of all where there are fewer; none without tokens."""

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - (k - 1))
        return (
            F.when(F.size(own) >= k, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(own, i, k), " "))))
            .when(F.size(own) > 0, F.array(F.array_join(own, " ")))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(tokens, runs)


def hashed_shingles(tokens: Column, k: int) -> Column:
    """As shingles, each as a 64-bit hash: no string is made for one."""

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - k)
        return (
            F.when(F.size(own) >= k, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(own, i + j) for j in range(k))))))
            .when(F.size(own) > 0, F.array(F.xxhash64(F.array_join(own, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(tokens, runs)


def hashed_code_shingles(code, k: int = C.CODE_SHINGLE) -> Column:
    return hashed_shingles(code_tokens(code), k)


def hashed_comment_shingles(text, k: int = C.COMMENT_SHINGLE) -> Column:
    return hashed_shingles(F.regexp_extract_all(F.lower(_col(text)), F.lit(C.COMMENT_WORD), F.lit(0)), k)


def code_shingles(code, k: int = C.CODE_SHINGLE) -> Column:
    return shingles(code_tokens(code), k)


def comment_shingles(text, k: int = C.COMMENT_SHINGLE) -> Column:
    return shingles(F.regexp_extract_all(F.lower(_col(text)), F.lit(C.COMMENT_WORD), F.lit(0)), k)


def split_of(repo, file, val_fraction: float = C.VAL_FRACTION) -> Column:
    """train or val by a hash of the file, so that a file is on one side only."""
    h = F.conv(F.substring(F.sha1(F.concat(_col(repo), F.lit("/"), _col(file))), 1, 8), 16, 10).cast("double")
    return F.when(h / F.lit(4294967295.0) < val_fraction, "val").otherwise("train")


def query_prefix(model, meta=None) -> Column:
    """Instruction for a model: by name, else from its metadata JSON, else none."""
    known = F.create_map(*(F.lit(x) for pair in C.QUERY_PREFIXES.items() for x in pair))
    own = F.get_json_object(_col(meta), "$.query_prefix") if meta is not None else F.lit(None)
    return F.coalesce(F.try_element_at(known, _col(model)), own, F.lit(""))


def reciprocal_rank(rank) -> Column:
    return 1.0 / _col(rank)


def recall_at(rank, k: int = 10) -> Column:
    return (_col(rank) <= k).cast("double")
