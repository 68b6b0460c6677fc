"""Host-level quality rules: document rule failures are aggregated by host, the rates are shrunk, and verdicts go back to the documents.

A document fails a rule by its own words. A host's failure rate is shrunk towards the mean of all hosts by a beta prior whose
two parameters are fitted to the hosts' rates by moments, so hosts of few documents are judged mildly. A host is
condemned when the shrunk rate of any rule reaches `host_limit`; its documents are then not kept. A null source is a host that is
never condemned, as its documents may come from anywhere.

Null texts have no words. Repeated rows count as often as they come. A null doc_id stays null; an empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows, materialize

#: Columns of the documents' own figures.
METRICS = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines", "odd_words")
#: Hosts whose verdicts are broadcast; beyond that many condemned hosts they are joined by shuffle.
BROADCAST_HOSTS = 200_000

_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS)
_SPACES = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    if len(ids) < 2_000_000:
        keys = (own[:-2] * len(ids) + own[1:-1]) * len(ids) + own[2:]
    else:  # the product of three numbers would overflow
        pairs = np.unique(own[:-1] * len(ids) + own[1:], return_inverse=True)[1]
        keys = pairs[:-1].astype(np.int64) * len(ids) + own[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def figures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words; n_lines counts lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    spaces = len(data) - len(data.translate(None, _SPACES))
    return len(words), len(text) - spaces, len(data.translate(None, _OTHERS)), len(lines) - len(set(lines)), len(lines), repeated_words(words)


def measure(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch):
            own = list(map(list, zip(*map(figures, batch.column("text").to_pylist()), strict=True)))
            return {"doc_id": batch.column("doc_id"), "source": batch.column("source")} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"), own, strict=True))

        return step

    return map_rows(docs, ["doc_id", "source", "text"], make, METRICS)


#: The rules in SQL, over the columns of METRICS; a rule of rates asks for at least one word.
RULE_SQL = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words AND n_words > 0",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_words": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def host_rates(figured: DataFrame) -> DataFrame:
    """source, rule, n, failed, shrunk for each host with a name and each rule."""
    wide = figured.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), *(F.sum(F.expr(f"CAST({sql} AS LONG)")).alias(rule) for rule, sql in RULE_SQL.items()))
    long = wide.select("source", "n", F.expr("stack({}, {}) AS (rule, failed)".format(len(RULES), ", ".join(f"'{r}', {r}" for r in RULES))))
    rate = F.col("failed") / F.col("n")
    # Method of moments over hosts: mean m and variance v of the rates give a + b = m (1 - m) / v - 1.
    prior = long.groupBy("rule").agg(F.avg(rate).alias("m"), (F.avg(rate * rate) - F.avg(rate) * F.avg(rate)).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    weight = F.when((F.col("v") <= 1e-12) | (spread <= 0), F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), spread / F.greatest("v", F.lit(1e-12)) - 1)))
    prior = prior.select("rule", "m", weight.alias("weight"))
    return long.join(F.broadcast(prior), "rule").select("source", "rule", "n", "failed", ((F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("shrunk"))


def judge(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """The documents' figures with base_failed, host_condemned and kept, a row for each row of docs."""
    figured = materialize(measure(docs), "figures")
    condemned = host_rates(figured).where(F.col("shrunk") >= host_limit).select("source").distinct().withColumn("host_condemned", F.lit(True))
    if condemned.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        condemned = F.broadcast(condemned)
    base = F.expr(f"({RULE_SQL['short']}) OR ({RULE_SQL['repeats']})")
    joined = figured.join(condemned, "source", "left").withColumns({"base_failed": base, "host_condemned": F.coalesce("host_condemned", F.lit(False))})
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_condemned")).alias("kept"), "host_condemned")
