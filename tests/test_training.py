import hashlib

import numpy as np
import pytest

from sieveline.operators import dense, training
from sieveline.sources import registry


def vectors(n, size=6, seed=4):
    draw = np.random.default_rng(seed)
    q = draw.normal(size=(n, size))
    turn = np.linalg.qr(draw.normal(size=(size, size)))[0]
    return [(i, (q[i] / np.linalg.norm(q[i])).tolist(), (q[i] @ turn / np.linalg.norm(q[i])).tolist(), draw.normal(size=size).tolist()) for i in range(n)]


def frame(spark, rows, negatives=True):
    df = spark.createDataFrame(rows, "pair_id long, q array<double>, d array<double>, negative array<double>").repartition(5)
    return df if negatives else df.drop("negative")


def plain(rows, o, negatives):
    """The same run in numpy: order, mini-batches, loss, clipping, AdamW and the rate, each anew from its definition."""
    size = len(rows[0][1])
    w, m, v, t, log = np.eye(size), np.zeros((size, size)), np.zeros((size, size)), 0, []
    full = len(rows) // o.batch_size
    per_epoch = min(o.steps or full, full)
    total = per_epoch * o.epochs
    warm = int(np.ceil(o.warmup_ratio * total))
    for epoch in range(o.epochs):
        order = sorted(rows, key=lambda r: (hashlib.sha1(f"{o.seed}/{epoch}/{r[0]}".encode()).hexdigest(), r[0]))
        for step in range(per_epoch):
            own = [b for b in range(full) if b * per_epoch // full == step]
            g, losses = np.zeros((size, size)), []
            for b in own:
                part = order[b * o.batch_size : (b + 1) * o.batch_size]
                q, every = np.array([r[1] for r in part]), np.array([r[2] for r in part] + ([r[3] for r in part] if negatives else []))
                for i in range(len(part)):
                    s = o.scale * (q[i] @ w @ every.T)
                    p = np.exp(s - np.logaddexp.reduce(s))
                    losses.append(np.logaddexp.reduce(s) - s[i])
                    g += o.scale * np.outer(q[i], p @ every - every[i]) / len(part)
            g /= len(own)
            g *= min(1.0, o.clip / np.linalg.norm(g))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            rate = o.learning_rate * (t / warm if t <= warm else (total - t + 1) / (total - warm))
            w = w * (1 - rate * o.weight_decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            log.append((t, np.mean(losses), rate))
    return w, log


@pytest.mark.parametrize(("options", "negatives"), [(training.Options(batch_size=8, epochs=2, scale=5.0, learning_rate=0.05), True), (training.Options(batch_size=4, steps=3, scale=5.0, seed=3), False)])
def test_equals_a_plain_run(spark, options, negatives):
    rows, got = vectors(43), []
    state = training.train(frame(spark, rows, negatives), options, lambda step, values: got.append((step, values["train_loss"], values["learning_rate"])))
    want, log = plain(rows, options, negatives)
    assert np.abs(state.weights - want).max() < 1e-9
    assert [x for r in got for x in r] == pytest.approx([x for r in log for x in r])


def test_loss_falls_and_a_cut_off_run_goes_on(spark, tmp_path):
    rows, options = vectors(64), training.Options(batch_size=16, epochs=3, scale=10.0, learning_rate=0.1, eval_every=2)
    pairs = frame(spark, rows, False)
    figures = []
    val = lambda w: dense.validation_ranks(training.mapped(pairs.select("pair_id", "q", "d"), w)).agg({"rank": "avg"}).first()[0]
    whole = training.train(pairs, options, lambda step, values: figures.append((step, values)), val)
    assert figures[-1][1]["train_loss"] < 0.8 * figures[1][1]["train_loss"] and figures[-1][1]["val_mrr"] < figures[0][1]["val_mrr"]
    path = str(tmp_path / "states")
    assert training.train(pairs, options, path=path, most_steps=5).step == 5
    assert training.load_state(spark, path).step == 4
    again = training.train(pairs, options, path=path)
    assert again.step == whole.step == 12 and np.abs(again.weights - whole.weights).max() < 1e-12


def test_odd_pairs(spark):
    rows = [(1, [1.0, 0.0], None, None), (2, None, [1.0, 0.0], None), (3, [1.0, 0.0], [0.0, 1.0], None)]
    assert training.train(frame(spark, rows), training.Options(batch_size=2)).step == 0
    assert training.train(frame(spark, []), training.Options(batch_size=2)).step == 0


def test_run_log(spark, tmp_path):
    log = registry.RunLog(spark, str(tmp_path / "runs"))
    assert log.runs().count() == 0 and log.metrics().count() == 0
    with log.run("a", {"lr": 0.1}, "hard", at_once=2) as report:
        report(1, {"train_loss": 3.0})
        report(2, {"train_loss": 2.0, "final_val_mrr": 0.5})
    with pytest.raises(RuntimeError), log.run("b", {}, "random") as report:
        report(1, {"train_loss": 9.0, "final_val_mrr": 0.9})
        raise RuntimeError("out of luck")
    log.start("c", {}, "random")
    log.log("c", [(1, "final_val_mrr", 0.8)])
    runs = {r.run_id: r for r in log.runs().collect()}
    assert {k: r.status for k, r in runs.items()} == {"a": "FINISHED", "b": "FAILED", "c": "STARTED"} and runs["a"].params == {"lr": "0.1"} and runs["a"].tag == "hard"
    # Steps that are done again replace their own figures; a run that comes again is the same run.
    log.log("a", [(2, "train_loss", 1.5), (2, "train_loss", 1.25)][:1])
    assert {(r.step, r.value) for r in registry.metric_history(log.metrics(), "a", "train_loss").collect()} == {(1, 3.0), (2, 1.5)}
    assert [r.run_id for r in registry.finished_runs(log.runs(), log.metrics()).collect()] == ["a"]
    with log.run("c", {}, "random"):
        pass
    assert registry.resolve_model("mlflow:best", log.runs(), log.metrics()).endswith("artifacts/c")
