"""Incremental postings: new document files are tokenized and counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.functions.text import tokenize
from sieveline.operators import lexical


def arriving(spark: SparkSession, folder: str, schema: str = "ordinal long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def keep_postings(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's postings and lengths below out. A batch's files are named by its number, so a batch that runs again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        docs = batch.select("ordinal", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
        lexical.postings(docs).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        docs.select("ordinal", F.size("tokens").alias("len")).write.mode("overwrite").parquet(f"{out}/lengths/batch={number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
