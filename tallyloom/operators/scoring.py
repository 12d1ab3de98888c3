"""From score vectors to predictions, losses, normalised and mixed vectors, and a trained model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.constants import CLASS_NAMES, MIXUP_ALPHA, MIXUP_SHARE
from tallyloom.functions.columns import argmax, exp_shifted, named_scores, ranked, strings, vector_sum


def softmax(df: DataFrame, logits: str, into: str = "probs") -> DataFrame:
    return (
        df.withColumn("_e", exp_shifted(F.col(logits)))
        .withColumn("_s", vector_sum(F.col("_e")))
        .withColumn(into, F.transform("_e", lambda x: x / F.col("_s")))
        .drop("_e", "_s")
    )


def score(df: DataFrame, logits: str, classes: Sequence[str] = CLASS_NAMES, digits: int = 4) -> DataFrame:
    """Add the predicted class, its confidence and the rounded score of every class."""
    place = argmax(F.col("probs"))
    return softmax(df, logits).withColumns({
        "predicted_class": F.get(strings(classes), place),
        "confidence": F.array_max("probs"),
        "all_scores": named_scores(classes, F.col("probs"), digits),
    })


def score_with(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Hook for a model that only exists in Python: `scorer` maps one pandas batch to another."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)
    return df.mapInPandas(run, schema)


def ranked_scores(df: DataFrame, key: str, scores: str = "all_scores") -> DataFrame:
    """One row per class in display order: rank 1 is the highest score."""
    return df.select(key, F.posexplode(ranked(F.col(scores))).alias("pos", "entry")).select(
        key, (F.col("pos") + 1).cast("long").alias("rank"), F.col("entry.key").alias("label"), F.col("entry.value").alias("score"))


def weighted_log_loss(df: DataFrame, probs: str, target: str, weight_vector: Sequence[float],
                      smoothing: float = 0.0) -> DataFrame:
    """Mean and class-weighted cross-entropy over probability vectors; `target` is the 0-based class.

    With smoothing s each class shares s/k of the target mass, weighted by its own class weight.
    """
    k = len(weight_vector)
    weights = F.array(*[F.lit(float(w)) for w in weight_vector])
    log_p = F.transform(F.col(probs), lambda p: -F.log(p))
    hit = F.get(log_p, F.col(target))
    own = F.get(weights, F.col(target))
    loss = own * hit * (1.0 - smoothing)
    if smoothing:
        spread = F.zip_with(weights, log_p, lambda w, l: w * l)
        loss = loss + vector_sum(spread) * (smoothing / k)
    return df.select(hit.alias("hit"), own.alias("own"), loss.alias("loss")).agg(
        F.count("*").alias("rows"),
        F.avg("hit").alias("mean_loss"),
        (F.sum("loss") / F.sum("own")).alias("weighted_loss"),
    )


def fit_moments(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population standard deviation per position."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def normalise_vectors(df: DataFrame, vector: str, mean: Sequence[float], std: Sequence[float],
                      into: str = "normalised") -> DataFrame:
    """(x - mean) / std per position; a position without spread is only centred."""
    scale = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s) or 1.0).alias("s")) for m, s in zip(mean, std)])
    return df.withColumn(into, F.zip_with(F.col(vector), scale, lambda x, p: (x.cast("double") - p["m"]) / p["s"]))


def fit_normalise(df: DataFrame, vector: str, into: str = "normalised") -> DataFrame:
    """Normalise with moments fitted on the table itself (one row per position reaches the driver)."""
    rows = sorted(fit_moments(df, vector).collect(), key=lambda r: r["pos"])
    return normalise_vectors(df, vector, [r["mean"] for r in rows], [r["std"] for r in rows], into)


def vector_mixup(df: DataFrame, vector: str, label: str, key: str, alpha: float = MIXUP_ALPHA,
                 batch_rows: int = 16, share: float = MIXUP_SHARE, seed: int = 42) -> DataFrame:
    """Blend each vector of a chosen batch with a partner from the same batch, keeping both labels.

    Batches are hash buckets of about `batch_rows` rows (`key` identifies rows). Inside a batch the
    rows stand in a seeded random order; the partner is the next row, and the first one for the last.
    `share` of the batches are mixed, the others (and all of them when alpha <= 0) keep their vectors
    with lam = 1. One shuffle, no join.
    """
    rows = df.count()
    batches = max(1, -(-rows // batch_rows))
    placed = df.select(
        F.col(key), F.col(vector), F.col(label),
        F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(batches)).alias("batch"),
        F.xxhash64(F.lit(seed + 1), F.col(key)).alias("_place"),
    )
    if alpha <= 0:
        return placed.select(
            key, "batch", F.col(vector).alias("mixed"), F.col(label).alias("label_a"), F.col(label).alias("label_b"),
            F.col(key).alias("partner"), F.lit(1.0).alias("lam"))

    @F.pandas_udf("double")
    def blend(batch: pd.Series) -> pd.Series:
        def draw(b: int) -> float:
            rng = np.random.default_rng([seed, int(b)])
            return float(rng.beta(alpha, alpha)) if rng.random() < share else 1.0
        known = {b: draw(b) for b in batch.unique()}
        return batch.map(known)

    other = F.struct(F.col(key).alias("partner"), F.col(vector).alias("v"), F.col(label).alias("label_b"))
    order = W.partitionBy("batch").orderBy("_place", key)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    paired = placed.withColumn("_other", F.coalesce(F.lead(other).over(order), F.first(other).over(whole)))
    paired = paired.withColumn("lam", blend("batch"))
    mixed = F.zip_with(
        F.col(vector), F.col("_other.v"),
        lambda x, y: F.col("lam") * x.cast("double") + (1.0 - F.col("lam")) * y.cast("double"))
    untouched = F.col("lam") == 1.0
    return paired.select(
        key, "batch",
        F.when(untouched, F.transform(F.col(vector), lambda x: x.cast("double"))).otherwise(mixed).alias("mixed"),
        F.col(label).alias("label_a"),
        F.when(untouched, F.col(label)).otherwise(F.col("_other.label_b")).alias("label_b"),
        F.when(untouched, F.col(key)).otherwise(F.col("_other.partner")).alias("partner"),
        "lam",
    )


def train_weighted(df: DataFrame, vector: str, label: str, weight: str = "weight", max_iter: int = 25,
                   reg: float = 0.01):
    """Multinomial logistic regression on feature vectors with per-row class weights."""
    ready = df.select(
        array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"),
        F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    learner = LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="weight", family="multinomial")
    return learner.fit(ready)


def predict(model, df: DataFrame, vector: str) -> DataFrame:
    """Add the class probabilities and the predicted 0-based class."""
    ready = df.withColumn("features", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    return (
        model.transform(ready)
        .withColumn("probs", vector_to_array("probability"))
        .withColumn("predicted", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability", "prediction")
    )
