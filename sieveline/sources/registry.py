"""Run registry and configuration: tables of runs, parameters and metrics; TOML run configurations."""

from __future__ import annotations

import time
import tomllib
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Options of a training run and their defaults.
RUN_OPTIONS = {
    "base_model": "BAAI/bge-small-en-v1.5", "negatives": "hard", "epochs": 1, "batch_size": 32, "learning_rate": 2e-5, "warmup_ratio": 0.1, "weight_decay": 0.01, "max_seq_length": 256,
    "scale": 20.0, "seed": 0, "max_train_pairs": 0, "max_val_pairs": 500, "eval_every": 50, "gradient_checkpointing": False, "threads": 0,
}
NEGATIVE_MODES = ("hard", "random", "none")


def run_config(text: str, run: str) -> dict:
    """[defaults] overlaid by [runs.<run>]; an unknown run or option is an error."""
    parsed = tomllib.loads(text)
    if run not in parsed.get("runs", {}):
        raise KeyError(f"no run {run!r}")
    own = parsed.get("defaults", {}) | parsed["runs"][run]
    unknown = sorted(set(own) - set(RUN_OPTIONS))
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    config = RUN_OPTIONS | own
    if config["negatives"] not in NEGATIVE_MODES:
        raise ValueError(f"unknown negative mode {config['negatives']!r}")
    return config


def overlay(defaults: Column, own: Column) -> Column:
    """A map with the entries of both; those of own win."""
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def finished_runs(runs: DataFrame, metrics: DataFrame, tag: str | None = None, key: str = "final_val_mrr") -> DataFrame:
    """Finished runs that have an artefact and the final metric, best first."""
    final = metrics.where(F.col("key") == key).groupBy("run_id").agg(F.max_by("value", "step").alias(key))
    own = runs.where("status = 'FINISHED' AND artifact IS NOT NULL")
    own = own.where(F.col("tag") == tag) if tag else own
    return own.join(final, "run_id").orderBy(F.desc(key), F.desc("start_time"), "run_id")


def resolve_model(spec: str, runs: DataFrame, metrics: DataFrame, prefix: str = "mlflow:") -> str:
    """prefix + best, best-<tag> or a run id as that run's artefact; any other name as it is."""
    if not spec.startswith(prefix):
        return spec
    key = spec.removeprefix(prefix)
    if key == "best" or key.startswith("best-"):
        found = finished_runs(runs, metrics, key[5:] or None).first()
    else:
        found = runs.where((F.col("run_id") == key) & F.col("artifact").isNotNull()).first()
    if found is None:
        raise LookupError(f"no run for {spec!r}")
    return found["artifact"]


def metric_history(metrics: DataFrame, run_id: str, key: str) -> DataFrame:
    return metrics.where((F.col("run_id") == run_id) & (F.col("key") == key)).select("step", "value").orderBy("step")


class RunLog:
    """Runs below a folder: what happened to them, their parameters, tags and metrics, as tables that are only ever added to.

    A metric is known by run, key and step: of several rows with the same ones the last written counts, so a step that is done again replaces its own rows. A run's state is
    its last event: STARTED for one that runs or was killed, FINISHED, or FAILED.
    """

    EVENTS = "run_id string, status string, tag string, artifact string, params map<string,string>, message string, at timestamp, attempt long"
    METRICS = "run_id string, key string, step long, value double, at timestamp, attempt long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _add(self, table: str, rows: list[tuple], schema: str) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        self.spark.createDataFrame([(*r, now, time.time_ns()) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def start(self, run_id: str, params: dict, tag: str | None = None) -> None:
        self._add("events", [(run_id, "STARTED", tag, None, {k: str(v) for k, v in params.items()}, None)], self.EVENTS)

    def finish(self, run_id: str, artifact: str | None = None) -> None:
        self._add("events", [(run_id, "FINISHED", None, artifact, None, None)], self.EVENTS)

    def fail(self, run_id: str, message: str) -> None:
        self._add("events", [(run_id, "FAILED", None, None, None, message)], self.EVENTS)

    def log(self, run_id: str, values: list[tuple[int, str, float]]) -> None:
        """(step, key, value) of one or more steps."""
        self._add("metrics", [(run_id, key, step, float(value)) for step, key, value in values], self.METRICS)

    def _read(self, table: str, schema: str) -> DataFrame:
        """What is written of a table; no rows where nothing is yet."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}") if there else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """run_id, status, tag, artifact, params, start_time of each run; a run that was started again has its last start."""
        last = lambda c, when: F.max_by(c, F.when(when, F.col("attempt")))
        started = F.col("status") == "STARTED"
        return self._read("events", self.EVENTS).groupBy("run_id").agg(
            F.max_by("status", "attempt").alias("status"), last("tag", started).alias("tag"), F.max_by("artifact", "attempt").alias("artifact"), last("params", started).alias("params"), last("at", started).alias("start_time"),
        )

    def metrics(self) -> DataFrame:
        """run_id, key, step, value."""
        return self._read("metrics", self.METRICS).groupBy("run_id", "key", "step").agg(F.max_by("value", "attempt").alias("value"))

    @contextmanager
    def run(self, run_id: str, params: dict, tag: str | None = None, at_once: int = 50):
        """A function log(step, values) for the body; the run is finished after it, or failed if it raises. Metrics are written some at a time, and before the state."""
        self.start(run_id, params, tag)
        waiting: list[tuple[int, str, float]] = []

        def log(step: int, values: dict) -> None:
            waiting.extend((step, key, value) for key, value in values.items())
            if len(waiting) >= at_once:
                self.log(run_id, waiting)
                waiting.clear()

        try:
            yield log
        except BaseException as error:
            if waiting:
                self.log(run_id, waiting)
            self.fail(run_id, f"{type(error).__name__}: {error}")
            raise
        if waiting:
            self.log(run_id, waiting)
        self.finish(run_id, f"{self.path}/artifacts/{run_id}")
