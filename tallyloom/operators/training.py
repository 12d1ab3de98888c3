"""Class-weighted softmax regression trained by epochs: one aggregation over the vectors per epoch.

An epoch is one scan. Each task adds up, for its rows, the gradient of the loss, the loss itself and hits, support and
predictions per class; the sums of all tasks are added by Spark and number classes * (positions + 4) in all, whatever the
number of rows. The driver holds the weights and moves them (Adam with decoupled weight decay, cosine rate). The scan of
epoch e sees the weights that epoch e - 1 left: it gives the gradient of the training rows and scores the held-out ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.constants import PATIENCE
from tallyloom.operators.lookup import encode

FACTS = 4  # rows of facts per class: the loss (all of it in the first place), hits, support, predictions
HISTORY = ("epoch int, learning_rate double, train_loss double, val_loss double, train_macro_f1 double, "
           "val_macro_f1 double, val_accuracy double")


@dataclass
class Training:
    """What a training leaves: one history row per epoch, the weights of the best epoch and whether it stopped early.

    `weights` has a row per class and a column per position, the last one for the constant."""
    classes: Sequence[str]
    history: list[tuple] = field(default_factory=list)
    weights: np.ndarray | None = None
    stopped_early: bool = False

    def table(self, spark: SparkSession, run: str) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY).withColumn("run", F.lit(run))


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights.T
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(1, keepdims=True)


def batch_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, class_weights: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, facts) of rows with vectors `x` (last column 1) and classes `y`, not yet divided by the sum of weights."""
    k = len(class_weights)
    p = probabilities(x, weights)
    own = class_weights[y]
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(p, 1e-300))
    total = (1 - smoothing) * own * loss[rows, y] + smoothing / k * (loss @ class_weights)
    push = (1 - smoothing) * own[:, None] * p
    push[rows, y] -= (1 - smoothing) * own
    push += smoothing / k * (p * class_weights.sum() - class_weights)
    facts = np.zeros((FACTS, k))
    facts[0, 0] = total.sum()
    guess = p.argmax(1)
    facts[1] = np.bincount(y[guess == y], minlength=k)
    facts[2] = np.bincount(y, minlength=k)
    facts[3] = np.bincount(guess, minlength=k)
    return push.T @ x, facts


def _task(weights: np.ndarray, class_weights: np.ndarray, smoothing: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = weights.size
        sums = np.zeros((2, size + FACTS * len(class_weights)))
        for batch in batches:
            x = np.hstack([np.stack(batch["x"].to_numpy()).astype(np.float64), np.ones((len(batch), 1))])
            y, held = batch["y"].to_numpy(np.int64), batch["held"].to_numpy(bool)
            for side in (0, 1):
                mine = held == bool(side)
                if mine.any():
                    gradient, facts = batch_sums(x[mine], y[mine], weights, class_weights, smoothing)
                    sums[side] += np.concatenate([gradient.ravel(), facts.ravel()])
        some = np.flatnonzero(sums.ravel())
        yield pd.DataFrame({"pos": some, "value": sums.ravel()[some]})
    return run


def _scores(facts: np.ndarray, class_weights: np.ndarray) -> tuple[float, float, float]:
    """(loss, macro F1, accuracy); macro averages run over classes seen in true or predicted."""
    hits, support, guessed = facts[1:]
    whole = float((support * class_weights).sum())
    seen = (support + guessed) > 0
    f1 = 2 * hits[seen] / (support + guessed)[seen]
    n = support.sum()
    return (float(facts[0, 0]) / whole if whole else 0.0, float(f1.mean()) if len(f1) else 0.0, float(hits.sum() / n) if n else 0.0)


def train_epochs(df: DataFrame, vector: str, label: str, held: str, classes: Sequence[str], class_weights: Mapping[str, float],
                 epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, smoothing: float = 0.1, patience: int = PATIENCE) -> Training:
    """Train on rows where `held` is false, score those where it is true after every epoch.

    Training ends after `patience` epochs without a strictly better macro F1 of the held-out rows. Rows without a vector, a
    label of `classes` or `held`, or with nulls or another length in the vector, are left out. The result keeps the weights of the first best epoch."""
    numbers = np.array([float(class_weights[c]) for c in classes])
    rows = encode(df.withColumn("_l", F.col(label).cast("string")), "_l", classes, "y").select(
        F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"), "y", F.col(held).alias("held")).where(
        F.col("y").isNotNull() & F.col("held").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    width = rows.agg(F.max(F.size("x")).alias("n")).first()["n"]
    made = Training(classes)
    if width is None:
        return made
    rows = rows.where(F.size("x") == width)
    k = len(classes)
    weights, first, second = (np.zeros((k, width + 1)) for _ in range(3))
    best, waited, train = 0.0, 0, None
    for epoch in range(1, epochs + 2):
        summed = rows.mapInPandas(_task(weights, numbers, smoothing), "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value"))
        sums = np.zeros((2, weights.size + FACTS * k))
        for r in summed.collect():  # one row per weight and class fact
            sums.flat[r["pos"]] = r["value"]
        (gradient, facts), (_, held_facts) = ((s[:weights.size].reshape(weights.shape), s[weights.size:].reshape(FACTS, k)) for s in sums)
        if epoch > 1:  # the held-out rows were scored with what the last epoch left
            val_loss, val_f1, val_accuracy = _scores(held_facts, numbers)
            made.history.append((epoch - 1, lr, train[0], val_loss, train[1], val_f1, val_accuracy))
            if val_f1 > best or made.weights is None:
                made.weights = weights.copy()
            best, waited = (val_f1, 0) if val_f1 > best else (best, waited + 1)
            if waited >= patience:
                made.stopped_early = epoch <= epochs
                break
        if epoch > epochs:
            break
        train = _scores(facts, numbers)
        lr = rate * (1 + math.cos(math.pi * (epoch - 1) / epochs)) / 2
        gradient /= max(float((facts[2] * numbers).sum()), 1e-300)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        step = (first / (1 - 0.9 ** epoch)) / (np.sqrt(second / (1 - 0.999 ** epoch)) + 1e-8)
        weights = weights * (1 - lr * decay) - lr * step
    return made


def predict_classes(df: DataFrame, vector: str, trained: Training, into: str = "predicted") -> DataFrame:
    """Adds the 0-based class with the highest score (the first of equal ones), as native expressions."""
    rows = [F.array(*[F.lit(float(w)) for w in row]) for row in trained.weights]
    x = F.concat(F.transform(F.col(vector), lambda v: v.cast("double")), F.array(F.lit(1.0)))
    scores = F.array(*[F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in rows])
    return df.withColumn(into, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
