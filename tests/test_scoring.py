import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.constants import CLASS_NAMES
from tallyloom.operators import evaluate, scoring


def test_softmax_is_stable_and_first_wins(spark):
    df = spark.createDataFrame([(1, [1000.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (2, [float(i) for i in range(7)])], "k int, z array<double>")
    found = {r["k"]: r for r in scoring.score(df, "z").collect()}
    assert found[1]["predicted_class"] == "akiec" and found[1]["confidence"] == 0.5
    e = np.exp(np.arange(7.0))
    assert found[2]["probs"] == pytest.approx(list(e / e.sum()))
    assert found[2]["predicted_class"] == "vasc"
    assert found[2]["all_scores"]["vasc"] == round(float(e[6] / e.sum()), 4)
    shown = scoring.ranked_scores(scoring.score(df, "z").where("k = 2"), "k").orderBy("rank").collect()
    assert [r["label"] for r in shown] == CLASS_NAMES[::-1]


def confusion_by_hand(pairs, label):
    tp = sum(t == p == label for t, p in pairs)
    return tp, sum(t == label for t, _ in pairs), sum(p == label for _, p in pairs)


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(300)]
    df = spark.createDataFrame(data, "t string, p string")
    pairs = evaluate.pair_counts(df, "t", "p")
    f1, weighted = {}, 0
    for label in "abcd":
        tp, support, predicted = confusion_by_hand(data, label)
        f1[label] = 2 * tp / (support + predicted) if support + predicted else 0.0
        weighted += f1[label] * support / len(data)
    row = evaluate.overall(pairs).first()
    assert row["accuracy"] == row["micro_f1"] == round(sum(t == p for t, p in data) / len(data), 4)
    assert row["macro_f1"] == pytest.approx(sum(f1.values()) / 4, abs=1e-4)
    assert row["weighted_f1"] == pytest.approx(weighted, abs=1e-4)
    # the fixed list adds a class nobody saw, and leaves out one that was predicted
    fixed = {r["label"]: r["f1"] for r in evaluate.per_class_f1(pairs, ["a", "b", "c", "zz"]).collect()}
    assert fixed["zz"] == 0.0 and fixed["a"] == pytest.approx(f1["a"], abs=1e-4) and "d" not in fixed
    cells = evaluate.confusion(df, "t", "p", ["a", "b", "zz"]).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells if "zz" in (r["true"], r["pred"])) == 0
    wrong = {r["label"]: r["mistake_pct"] for r in evaluate.mistake_pct(pairs, ["a", "zz"]).collect()}
    tp, support, _ = confusion_by_hand(data, "a")
    assert wrong == {"a": round((support - tp) / support * 100, 2), "zz": 0.0}
    doc = evaluate.metrics_document(pairs, ["a", "b"]).first()
    assert list(doc["per_class_f1"]) == ["a", "b"] and doc["accuracy"] == row["accuracy"]
    report = {r["label"]: r for r in evaluate.report(pairs, list("abcd")).collect()}
    assert report["macro avg"]["f1"] == pytest.approx(sum(f1.values()) / 4) and report["accuracy"]["support"] == 300


def test_promote_takes_the_numerically_latest(spark, rows):
    runs = spark.createDataFrame([("m", "9", 0.9), ("m", "10", 0.75), ("m", "11", 0.7499), ("n", "1", 0.1)], "name string, version string, macro_f1 double")
    assert rows(evaluate.promote(runs, "name", "version", "macro_f1")) == [("m", 10, 0.75, 2, "production")]


def test_metric_names(spark, rows):
    df = spark.createDataFrame([("mel", 0.5)], "label string, f1 double")
    assert rows(evaluate.to_metric_rows(df, "label", "f1", "val_f1", 7)) == [("val_f1_mel", 0.5, 7)]


def test_log_loss_with_smoothing(spark):
    probs = [[0.7, 0.2, 0.1], [0.1, 0.1, 0.8]]
    df = spark.createDataFrame([(probs[0], 0), (probs[1], 1)], "p array<double>, y int")
    w, s = [1.0, 2.0, 4.0], 0.1
    loss = sum(
        (1 - s) * w[y] * -math.log(p[y]) + s / 3 * sum(w[c] * -math.log(p[c]) for c in range(3)) for p, y in zip(probs, (0, 1)))
    row = scoring.weighted_log_loss(df, "p", "y", w, s).first()
    assert row["weighted_loss"] == pytest.approx(loss / (w[0] + w[1]))
    plain = scoring.weighted_log_loss(df, "p", "y", w).first()
    assert plain["mean_loss"] == pytest.approx((-math.log(0.7) - math.log(0.1)) / 2)


def test_normalise(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    assert [r["normalised"] for r in scoring.fit_normalise(df, "v").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_mixup_invariants(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    mixed = scoring.vector_mixup(df, "v", "label", "k", alpha=0.4, share=0.5, seed=5)
    found = mixed.collect()
    again = {r["k"]: r["lam"] for r in scoring.vector_mixup(df.repartition(9), "v", "label", "k", alpha=0.4, share=0.5, seed=5).collect()}
    assert len(found) == 400 and {r["k"]: r["lam"] for r in found} == again
    batch = {r["k"]: r["batch"] for r in found}
    lam = {}
    for r in found:
        assert 0 <= r["lam"] <= 1 and lam.setdefault(r["batch"], r["lam"]) == r["lam"]
        assert batch[r["partner"]] == r["batch"]
        assert (r["label_a"], r["label_b"]) == (r["k"] % 3, r["partner"] % 3)
        assert r["mixed"] == pytest.approx([r["lam"] * r["k"] + (1 - r["lam"]) * r["partner"], 1.0])
    chosen = [r for r in found if r["lam"] < 1]
    assert chosen and sorted(r["k"] for r in chosen) == sorted(r["partner"] for r in chosen)
    same = scoring.vector_mixup(df, "v", "label", "k", alpha=0.0).collect()
    assert all(r["lam"] == 1.0 and r["label_a"] == r["label_b"] and r["partner"] == r["k"] for r in same)


def test_weighted_training_learns(spark):
    rng = np.random.default_rng(0)
    data = [([float(x) for x in rng.normal(3 * (i % 3), 0.5, 4)], i % 3, 1.0) for i in range(300)]
    df = spark.createDataFrame(data, "v array<double>, y int, weight double")
    model = scoring.train_weighted(df, "v", "y")
    fitted = scoring.predict(model, df, "v")
    assert evaluate.overall(evaluate.pair_counts(fitted, "y", "predicted")).first()["accuracy"] > 0.95


def test_python_scorer_hook(spark):
    df = spark.range(3)
    out = scoring.score_with(df, lambda batch: batch.assign(twice=batch["id"] * 2), "id long, twice long")
    assert sorted(r["twice"] for r in out.collect()) == [0, 2, 4]


def test_report_covers_unlisted_labels_and_missing_predictions(spark):
    from tallyloom.operators import evaluate

    rows = spark.createDataFrame([("a", "a"), ("b", "b"), ("x", "y"), ("x", "x"), ("a", None), (None, "a"), ("y", "b"), ("a", "z")], "t string, p string")
    pairs = evaluate.pair_counts(rows, "t", "p")
    found = {r["label"]: r for r in evaluate.report(pairs, ["a", "b"]).collect()}
    assert found["accuracy"]["precision"] == evaluate.overall(pairs).first()["accuracy"] == round(3 / 7, 4) or abs(found["accuracy"]["precision"] - 3 / 7) < 1e-12
    assert found["accuracy"]["support"] == 7 and found["other"]["support"] == 3
    assert found["macro avg"]["recall"] == (1 / 3 + 1) / 2
    assert tuple(evaluate.unscored(rows, "t", "p").first()) == (1, 1)
    listed = evaluate.report(evaluate.pair_counts(rows.limit(2), "t", "p"), ["a", "b"])
    assert "other" not in {r["label"] for r in listed.collect()}
