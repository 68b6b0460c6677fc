"""Tables that a plan needs more than once are written below the session's checkpoint folder and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only where it is unset and all runs on this machine, a local folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    if not _written:
        atexit.register(_clean)
    path = f"{folder(spark)}/sieveline/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df computed once; any executor can read it, also after another one was lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return
