"""Training by epochs against a plain NumPy run over the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evaluate, ordered, training

CLASSES = ["0", "1", "2"]
WEIGHTS = {"0": 0.5, "1": 2.0, "2": 1.3}


def data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 5)).astype(np.float32) + np.eye(3, 5)[y] * 1.5
    return x.astype(np.float32), y, np.arange(n) % 4 == 0


def frame(spark, x, y, held):
    rows = [(i, [float(v) for v in row], int(c), bool(h)) for i, (row, c, h) in enumerate(zip(x, y, held, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<float>, label int, held boolean")


def macro_f1(truth, guess):
    out = [2 * np.sum((truth == c) & (guess == c)) / (np.sum(truth == c) + np.sum(guess == c)) for c in set(truth) | set(guess)]
    return float(np.mean(out))


def plain(x, y, held, epochs, rate, decay, smoothing):
    """Smoothed weighted cross entropy and Adam, written out for the whole matrix."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    cw = np.array([WEIGHTS[c] for c in CLASSES])
    w, m, v = (np.zeros((3, 6)) for _ in range(3))
    target = (1 - smoothing) * np.eye(3)[y] * cw + smoothing / 3 * cw  # each class's share, weighted by its class weight

    def losses(rows):
        z = x[rows] @ w.T
        logp = z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
        return -(target[rows] * logp).sum() / cw[y[rows]].sum(), np.exp(logp)

    history = []
    for e in range(1, epochs + 1):
        loss, p = losses(~held)
        f1 = macro_f1(y[~held], p.argmax(1))
        grad = (p * target[~held].sum(1, keepdims=True) - target[~held]).T @ x[~held] / cw[y[~held]].sum()
        lr = rate * (1 + math.cos(math.pi * (e - 1) / epochs)) / 2
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w * (1 - lr * decay) - lr * (m / (1 - 0.9 ** e)) / (np.sqrt(v / (1 - 0.999 ** e)) + 1e-8)
        val, q = losses(held)
        history.append((e, lr, loss, val, f1, macro_f1(y[held], q.argmax(1)), float((q.argmax(1) == y[held]).mean()), w.copy()))
    return history


def test_same_weights_and_history_as_numpy(spark):
    x, y, held = data()
    made = training.train_epochs(frame(spark, x, y, held).repartition(5), "v", "label", "held", CLASSES, WEIGHTS, 6, 0.2, 1e-3, 0.1, 50)
    want = plain(x, y, held, 6, 0.2, 1e-3, 0.1)
    assert not made.stopped_early and np.allclose([h[:7] for h in want], made.history, atol=1e-9)
    best = max(want, key=lambda h: (h[5], -h[0]))
    assert np.abs(made.weights - best[7]).max() < 1e-6


def test_history_feeds_early_stopping_and_the_gate(spark):
    x, y, held = data(seed=2)
    df = frame(spark, x, y, held)
    made = training.train_epochs(df, "v", "label", "held", CLASSES, WEIGHTS, 40, 0.3, patience=3)
    end = ordered.early_stopping(made.table(spark, "r"), "val_macro_f1", "epoch", "run", 3).first()
    assert made.stopped_early and end.stopped_early and end.steps_run == len(made.history) < 40
    scores = [h[5] for h in made.history]
    assert end.best_value == max(scores) and end.best_step == 1 + scores.index(max(scores))
    found = training.predict_classes(df.where("held"), "v", made)
    assert macro_f1(np.array([r.label for r in found.collect()]), np.array([r.predicted for r in found.collect()])) == pytest.approx(max(scores))
    assert evaluate.overall(evaluate.pair_counts(found, "label", "predicted")).first()["macro_f1"] == pytest.approx(max(scores), abs=1e-4)


def test_odd_rows(spark):
    x, y, held = data(40)
    df = frame(spark, x, y, held)
    odd = spark.createDataFrame([(900, None, 1, False), (901, [1.0], 1, False), (902, [1.0, None, 1.0, 1.0, 1.0], 1, True), (903, [1.0] * 5, None, False),
                                 (904, [1.0] * 5, 7, True), (905, [1.0] * 5, 1, None)], df.schema)
    same = training.train_epochs(df.unionByName(odd).withColumns({"x": F.lit(1), "y": F.lit(2)}), "v", "label", "held", CLASSES, WEIGHTS, 2)
    assert np.allclose(same.history, training.train_epochs(df, "v", "label", "held", CLASSES, WEIGHTS, 2).history)
    none = training.train_epochs(df.limit(0), "v", "label", "held", CLASSES, WEIGHTS, 2)
    assert none.history == [] and none.weights is None
    unheld = training.train_epochs(df.where("not held"), "v", "label", "held", CLASSES, WEIGHTS, 2)
    assert [h[3] for h in unheld.history] == [0.0, 0.0] and unheld.weights is not None
