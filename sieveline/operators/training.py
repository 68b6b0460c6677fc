"""Contrastive training of a linear map over given vectors, with gradients summed in executors.

A pair's query is to be closest to its own document among the documents of its mini-batch and, where there are negatives, those: softmax over scale * q M d, from M as the identity. A
step takes the mean gradient of one or more mini-batches, clips it and moves M by AdamW, with a linear warm-up and decay. The model and its moments are of a set size and live on the
driver; the pairs never do. All that a step draws hangs on the seed and the pairs' ids, so a resumed run goes on as the first one would have.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import let
from sieveline.operators.mining import draw
from sieveline.operators.numbering import numbered
from sieveline.sources.scratch import written

#: Partial sums that meet in one task.
FAN_IN = 16


class Options(NamedTuple):
    """steps: how many steps an epoch's mini-batches are dealt into; 0 for one step each."""

    batch_size: int = 32
    epochs: int = 1
    steps: int = 0
    learning_rate: float = 0.02
    warmup_ratio: float = 0.1
    weight_decay: float = 0.01
    clip: float = 1.0
    scale: float = 20.0
    seed: int = 0
    eval_every: int = 50


class State(NamedTuple):
    step: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray


def batches(pairs: DataFrame, options: Options, epoch: int) -> DataFrame:
    """pairs(pair_id, q, d[, negative]) in the epoch's order as mini-batches: batch, ids, qs, ds, ns. The last, incomplete one is dropped, as are pairs without both vectors."""
    own = pairs.where("q IS NOT NULL AND d IS NOT NULL")
    own = own if "negative" in own.columns else own.withColumn("negative", F.lit(None).cast("array<double>"))
    order = numbered(own.select("pair_id", "q", "d", "negative"), [draw(options.seed, F.lit(str(epoch)), F.col("pair_id").cast("string")), "pair_id"], name="nth", label="epoch")
    rows = order.groupBy(F.floor(F.col("nth") / options.batch_size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("nth", "q", "d", "negative"))).alias("x"))
    return rows.where(F.size("x") == options.batch_size).select("batch", F.col("x.q").alias("qs"), F.col("x.d").alias("ds"), F.filter(F.col("x.negative"), lambda n: n.isNotNull()).alias("ns"))


def loss_and_gradient(weights: np.ndarray, qs: np.ndarray, ds: np.ndarray, ns: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Of one mini-batch: the mean loss of its pairs, and its gradient by the map."""
    every = np.concatenate([ds, ns]) if len(ns) else ds
    s = scale * (qs @ weights) @ every.T
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(qs))
    loss = float(-np.log(np.maximum(p[at, at], 1e-300)).mean())
    p[at, at] -= 1
    return loss, scale * qs.T @ (p @ every) / len(qs)


def learning_rate(options: Options, step: int, total: int) -> float:
    """Of step 1 to total: up to the full rate over the warm-up, then down to 0 after the last one."""
    warm = math.ceil(options.warmup_ratio * total)
    return options.learning_rate * (step / warm if step <= warm else (total - step + 1) / max(1, total - warm))


def moved(state: State, gradient: np.ndarray, options: Options, total: int) -> State:
    """One step of AdamW with the clipped gradient."""
    step = state.step + 1
    norm = float(np.sqrt((gradient**2).sum()))
    g = gradient * min(1.0, options.clip / norm) if norm else gradient
    first, second = 0.9 * state.first + 0.1 * g, 0.999 * state.second + 0.001 * g * g
    rate = learning_rate(options, step, total)
    change = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return State(step, state.weights * (1 - rate * options.weight_decay) - rate * change, first, second)


def summed(rows: DataFrame, weights: np.ndarray, scale: float) -> tuple[float, np.ndarray, int]:
    """The sums of losses and gradients of mini-batches, and their number. Tasks add up their own; their sums are added up FAN_IN at a time; the driver gets the last few."""
    spark, size = rows.sparkSession, weights.shape[0]
    sent = spark.sparkContext.broadcast(weights)
    schema = "part long, loss double, n long, gradient array<double>"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        loss, n, total = 0.0, 0, np.zeros((size, size))
        for frame in frames:
            for qs, ds, ns in zip(frame["qs"], frame["ds"], frame["ns"], strict=True):
                as_rows = lambda x: np.array([np.asarray(v, float) for v in x]).reshape(-1, size)
                own, g = loss_and_gradient(sent.value, as_rows(qs), as_rows(ds), as_rows(ns), scale)
                loss, n, total = loss + own, n + 1, total + g
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "loss": [loss], "n": [n], "gradient": [total.ravel()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN_IN], "loss": [frame["loss"].sum()], "n": [frame["n"].sum()], "gradient": [np.sum(np.stack(frame["gradient"].to_list()), axis=0)]})

    parts = rows.select("qs", "ds", "ns").mapInPandas(task, schema)
    many = rows.rdd.getNumPartitions()
    while many > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
        many = -(-many // FAN_IN)
    found = parts.toPandas()  # FAN_IN rows at most
    sent.unpersist()
    return float(found["loss"].sum()), np.sum(np.stack(found["gradient"].to_list()), axis=0).reshape(size, size) if len(found) else np.zeros((size, size)), int(found["n"].sum())


def mapped(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """pairs(pair_id, q, d) with the map behind q."""
    columns = F.array(*(F.array(*map(F.lit, column.tolist())) for column in weights.T))
    moved_ = let("q", lambda q: F.transform(columns, lambda c: F.aggregate(F.zip_with(q, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
    return pairs.select("pair_id", moved_.alias("q"), "d")


def save_state(spark, path: str, state: State) -> None:
    """As a version of its own, so that a run that dies while it saves goes on from the one before."""
    rows = [(state.step, state.weights.shape[0], json.dumps([a.ravel().tolist() for a in state[1:]]))]
    spark.createDataFrame(rows, "step long, size int, arrays string").coalesce(1).write.mode("append").parquet(path)


def load_state(spark, path: str) -> State | None:
    try:
        row = spark.read.parquet(path).orderBy(F.desc("step")).first()
    except AnalysisException:
        return None
    return row and State(row["step"], *(np.array(a).reshape(row["size"], row["size"]) for a in json.loads(row["arrays"])))


def train(pairs: DataFrame, options: Options = Options(), log: Callable[[int, dict], None] = lambda step, values: None, evaluate: Callable[[np.ndarray], float] | None = None, path: str | None = None, most_steps: int | None = None) -> State:  # noqa: B008
    """The state after all steps (or most_steps of this call). log gets each step's train_loss and learning_rate, and val_mrr by `evaluate` at 0, every eval_every steps and the end. path: where
    states are saved, at each evaluation, and where a run that was cut off goes on from."""
    spark = pairs.sparkSession
    pairs = written(pairs, "training-pairs")
    row = pairs.where("q IS NOT NULL").select(F.size("q").alias("n")).first()
    size = row["n"] if row else 0
    state = (load_state(spark, path) if path else None) or State(0, np.eye(size), np.zeros((size, size)), np.zeros((size, size)))
    full = pairs.where("q IS NOT NULL AND d IS NOT NULL").count() // options.batch_size
    per_epoch = min(options.steps or full, full)
    total, done = per_epoch * options.epochs, 0
    if evaluate and not state.step:
        log(0, {"val_mrr": evaluate(state.weights)})
    for epoch in range(options.epochs):
        if state.step >= (epoch + 1) * per_epoch:
            continue
        place = F.floor(F.col("batch") * per_epoch / full).cast("int")
        rows = batches(pairs, options, epoch).withColumn("step", place)
        # By step, so that each one reads its own mini-batches only.
        for step, own in _by_step(rows, per_epoch, state.step - epoch * per_epoch):
            if most_steps is not None and done == most_steps:
                return state
            loss, gradient, n = summed(own, state.weights, options.scale)
            state, done = moved(state, gradient / n, options, total), done + 1
            values = {"train_loss": loss / n, "learning_rate": learning_rate(options, state.step, total)}
            if evaluate and (state.step % options.eval_every == 0 or state.step == total):
                values["val_mrr"] = evaluate(state.weights)
            log(state.step, values)
            if path and (state.step % options.eval_every == 0 or state.step == total):
                save_state(spark, path, state)
    return state


def _by_step(rows: DataFrame, steps: int, begin: int) -> Iterator[tuple[int, DataFrame]]:
    from sieveline.sources.scratch import new_path

    path = new_path(rows.sparkSession, "mini-batches")
    rows.write.partitionBy("step").parquet(path)
    read = rows.sparkSession.read.schema(rows.schema).parquet(path)
    for step in range(begin, steps):
        yield step, read.where(F.col("step") == step)
