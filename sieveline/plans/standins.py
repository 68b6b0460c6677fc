"""The retrieval tables as the given tables stand for them, in Spark and in SQL.

A document is a unit: its first line is its comment, the rest its body, its first word its name and all further words what it calls; the
language is its repository, the source its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = ("src0", "src5", "src10", "src15")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    comment = F.substring_index("text", "\n", 1)
    file = F.concat("source", F.when(F.col("source").isin(*HEADERS), ".h").otherwise(".c"))
    name = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("_"))
    return docs.select(
        F.col("lang").alias("repo"), F.col("doc_id").alias("ordinal"), F.concat(file, F.lit("::"), name, F.lit("@"), F.col("doc_id").cast("string")).alias("id"), name.alias("name"), file.alias("file"),
        comment.alias("comment"), comment.alias("comment_raw"), F.substring("text", F.length(comment) + 2, F.length("text")).alias("body"), F.size(F.split("text", "\n")).alias("n_lines"), (F.col("doc_id") % 2 == 1).alias("is_static"),
        F.array_distinct(F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).alias("calls"), F.col("doc_id").cast("int").alias("start_line"), (F.col("doc_id") + F.size(F.split("text", "\n"))).cast("int").alias("end_line"), comment.alias("signature"), "text",
    )


#: The same in SQL; `w` has the words, for the calls.
UNITS = r"""d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT lang AS repo, doc_id AS ordinal, coalesce(w[1], '_') AS name, w, source || CASE WHEN source IN ('src0', 'src5', 'src10', 'src15') THEN '.h' ELSE '.c' END AS file,
    split_part(text, chr(10), 1) AS comment, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, len(string_split(text, chr(10))) AS n_lines, doc_id % 2 = 1 AS is_static, text
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*') AS w FROM d)
),
units AS (SELECT *, file || '::' || name || '@' || ordinal AS id FROM u)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    return units(spark, sf_dir).join(vectors, "ordinal")


CORPUS = UNITS + ",\ncorpus AS (SELECT units.*, embedding FROM units JOIN embeddings ON ordinal = vec_id)"
