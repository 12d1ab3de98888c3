"""Scoring and evaluation on embeddings and document labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.constants import CLASS_NAMES
from tallyloom.operators import evaluate, ordered, ranks, scoring, training
from tallyloom.operators.lookup import class_dimension, risk_lookup
from tallyloom.operators.profile import class_distribution
from tallyloom.operators.split import class_weights, row_weights
from tallyloom.plans import serving
from tallyloom.plans.registry import query, rounded

WEIGHTS = [4.4089, 2.7846, 1.2918, 13.0845, 1.2877, 0.2133, 10.1405]


def logits(t):
    """One score per class from the whole vector: class k sums the positions that leave k modulo the number of classes."""
    def part(k):
        own = F.filter("embedding", lambda x, i: i % len(CLASS_NAMES) == k)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return t.embeddings.select("vec_id", "label", F.array(*[part(k) * 20.0 for k in range(len(CLASS_NAMES))]).alias("logits"))


def predictions(t):
    return scoring.score(logits(t), "logits").withColumn("truth", F.get(
        F.array(*[F.lit(c) for c in CLASS_NAMES]), F.col("label") % 7))


_SCORED = f"""
x AS (SELECT vec_id, label, list_transform(range(7), lambda k: 20.0 * list_sum(list_transform(
        list_filter(range(1, len(embedding) + 1), lambda i: (i - 1) % 7 = k), lambda i: CAST(embedding[i] AS DOUBLE)))) AS z FROM embeddings),
e AS (SELECT vec_id, label, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM x),
p AS (SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
c AS (SELECT vec_id, label, p, list_max(p) AS confidence,
             {CLASS_NAMES}[list_position(p, list_max(p))] AS predicted_class, {CLASS_NAMES}[label % 7 + 1] AS truth FROM p)
"""


@query("softmax_scores", f"""
WITH {_SCORED}
SELECT vec_id, predicted_class, round(confidence, 6) AS confidence, {", ".join(f"round(p[{i + 1}], 4) AS {c}" for i, c in enumerate(CLASS_NAMES))} FROM c
""")
def softmax_scores(t):
    scored = predictions(t)
    return scored.select(
        "vec_id", "predicted_class", F.round("confidence", 6).alias("confidence"),
        *[F.col("all_scores")[c].alias(c) for c in CLASS_NAMES])


@query("predicted_risk", f"""
WITH {_SCORED}
SELECT vec_id, predicted_class,
       CASE predicted_class WHEN 'mel' THEN 'HIGH' WHEN 'bcc' THEN 'MEDIUM' WHEN 'akiec' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       predicted_class = 'mel' AS high_risk,
       CASE predicted_class WHEN 'mel' THEN 5 WHEN 'nv' THEN 4 WHEN 'vasc' THEN 2 ELSE 3 END AS n_symptoms FROM c
""")
def predicted_risk(t):
    found = risk_lookup(predictions(t).select("vec_id", "predicted_class"), "predicted_class", class_dimension(t.spark))
    return found.select("vec_id", "predicted_class", "risk_level", "high_risk", F.size("symptoms").alias("n_symptoms"))


@query("ranked_scores", f"""
WITH {_SCORED}, u AS (SELECT vec_id, unnest({CLASS_NAMES}) AS label, unnest(p) AS s FROM c)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 4) DESC, label) AS rank, label, round(s, 4) AS score FROM u
""")
def ranked_scores(t):
    return scoring.ranked_scores(predictions(t), "vec_id")


@query("vector_normalise", """
WITH u AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM u GROUP BY 1)
SELECT vec_id, CAST(u.pos AS INTEGER) AS pos, round((x - mean) / std, 5) AS x FROM u JOIN m ON u.pos = m.pos
""")
def vector_normalise(t):
    scaled = scoring.fit_normalise(t.embeddings.select("vec_id", "embedding"), "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("normalised").alias("pos", "x")), 5, "x")


@query("vector_mixup")
def vector_mixup(t):
    mixed = scoring.vector_mixup(t.embeddings, "embedding", "label", "vec_id", alpha=0.4, share=0.5)
    return mixed.select("vec_id", "partner", "batch", "label_a", "label_b", "lam", "mixed")


def class_pairs(t):
    return evaluate.pair_counts(predictions(t), "truth", "predicted_class")


_GRID = f"""
grid AS (SELECT a.c AS true, b.c AS pred FROM (SELECT unnest({CLASS_NAMES}) AS c) a, (SELECT unnest({CLASS_NAMES}) AS c) b)
"""
_PER_CLASS = f"""
{_SCORED},
k AS (SELECT unnest({CLASS_NAMES}) AS label),
pc AS (SELECT label, (SELECT count(*) FROM c WHERE truth = k.label AND predicted_class = k.label) AS tp,
              (SELECT count(*) FROM c WHERE truth = k.label) AS support,
              (SELECT count(*) FROM c WHERE predicted_class = k.label) AS predicted FROM k),
f AS (SELECT label, tp, support, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
             CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0 END AS f1 FROM pc)
"""


@query("confusion_matrix", f"""
WITH {_SCORED}, {_GRID}
SELECT grid.true, grid.pred, count(vec_id) AS n FROM grid LEFT JOIN c ON c.truth = grid.true AND c.predicted_class = grid.pred GROUP BY ALL
""")
def confusion_matrix(t):
    return evaluate.confusion(predictions(t), "truth", "predicted_class", CLASS_NAMES)


@query("per_class_f1", f"WITH {_PER_CLASS} SELECT label, round(f1, 4) AS f1 FROM f")
def per_class_f1(t):
    return evaluate.per_class_f1(class_pairs(t), CLASS_NAMES)


@query("mistake_pct", f"""
WITH {_PER_CLASS} SELECT label, round(CASE WHEN support > 0 THEN (support - tp) * 100.0 / support ELSE 0 END, 2) AS mistake_pct FROM f
""")
def mistake_pct(t):
    return evaluate.mistake_pct(class_pairs(t), CLASS_NAMES)


@query("classification_report", f"""
WITH {_PER_CLASS}
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
                 round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f
""")
def classification_report(t):
    return rounded(evaluate.report(class_pairs(t), CLASS_NAMES), 9, "precision", "recall", "f1")


@query("report_unlisted", f"""
WITH {_SCORED}, s AS (SELECT CASE WHEN truth = 'nv' THEN 'unknown' ELSE truth END AS t,
  CASE WHEN vec_id % 10 = 0 THEN NULL WHEN predicted_class = 'mel' THEN 'novel' ELSE predicted_class END AS p FROM c),
k AS (SELECT unnest({CLASS_NAMES}) AS label UNION ALL SELECT 'other'),
n AS (SELECT CASE WHEN list_contains({CLASS_NAMES}, t) THEN t ELSE 'other' END AS t, CASE WHEN list_contains({CLASS_NAMES}, p) THEN p WHEN p IS NOT NULL THEN 'other' END AS p,
             coalesce(t = p, false) AS hit FROM s)
SELECT label, (SELECT count(*) FROM n WHERE n.t = k.label) AS support, (SELECT count(*) FROM n WHERE n.p = k.label) AS predicted,
       (SELECT count(*) FROM n WHERE n.t = k.label AND hit) AS hits FROM k
UNION ALL SELECT 'accuracy', count(*), count(p), count(*) FILTER (hit) FROM n
""")
def report_unlisted(t):
    """Labels outside the class list and rows without prediction stay in all totals."""
    rows = predictions(t).withColumns({
        "truth": F.when(F.col("truth") == "nv", "unknown").otherwise(F.col("truth")),
        "predicted_class": F.when(F.col("vec_id") % 10 != 0, F.when(F.col("predicted_class") == "mel", "novel").otherwise(F.col("predicted_class")))})
    pairs = evaluate.pair_counts(rows, "truth", "predicted_class")
    classes = evaluate.over_classes(pairs, CLASS_NAMES, other=True).select("label", "support", "predicted", F.col("tp").alias("hits"))
    return classes.unionByName(classes.agg(
        F.lit("accuracy").alias("label"), *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]))


@query("overall_metrics", """
WITH r AS (SELECT quality AS y, CASE WHEN n_chars > 400 THEN CASE WHEN toxic = 1 THEN 2 ELSE 1 END ELSE 0 END AS p
           FROM documents JOIN labels USING (doc_id)),
k AS (SELECT y AS label FROM r UNION SELECT p FROM r),
pc AS (SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y = label) AS support,
              count(*) FILTER (p = label) AS predicted FROM k, r GROUP BY 1),
f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re,
             CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0 END AS f1 FROM pc)
SELECT round(sum(tp) / sum(support), 4) AS accuracy,
       round(avg(f1), 4) AS macro_f1, round(sum(tp) / sum(support), 4) AS micro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1,
       round(avg(pr), 4) AS macro_precision, round(sum(tp) / sum(support), 4) AS micro_precision, round(sum(pr * support) / sum(support), 4) AS weighted_precision,
       round(avg(re), 4) AS macro_recall, round(sum(tp) / sum(support), 4) AS micro_recall, round(sum(re * support) / sum(support), 4) AS weighted_recall
FROM f
""")
def overall_metrics(t):
    guess = F.when(F.col("n_chars") > 400, F.when(F.col("toxic") == 1, 2).otherwise(1)).otherwise(0)
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").withColumn("guess", guess)
    return evaluate.overall(evaluate.pair_counts(rows, "quality", "guess"))


def _loss_sql(smoothing: float) -> str:
    return f"""
WITH {_SCORED},
w AS (SELECT p, label % 7 + 1 AS y, {WEIGHTS} AS w FROM c),
l AS (SELECT -ln(p[y]) AS hit, w[y] AS own,
             {1 - smoothing} * w[y] * -ln(p[y]) + {smoothing} / 7 * list_sum(list_transform(range(1, 8), lambda i: w[i] * -ln(p[i]))) AS loss FROM w)
SELECT count(*) AS rows, round(avg(hit), 7) AS mean_loss, round(sum(loss) / sum(own), 7) AS weighted_loss FROM l
"""


@query("weighted_log_loss", _loss_sql(0.0))
def weighted_log_loss(t):
    scored = predictions(t).withColumn("y", F.col("label") % 7)
    return rounded(scoring.weighted_log_loss(scored, "probs", "y", WEIGHTS), 7, "mean_loss", "weighted_loss")


@query("smoothed_log_loss", _loss_sql(0.1))
def smoothed_log_loss(t):
    scored = predictions(t).withColumn("y", F.col("label") % 7)
    return rounded(scoring.weighted_log_loss(scored, "probs", "y", WEIGHTS, smoothing=0.1), 7, "mean_loss", "weighted_loss")


def daily_history(t):
    """One training run per user: the daily mean value as metric."""
    return t.events.groupBy("user_id", F.dayofmonth("ts").alias("epoch")).agg((F.avg("value") / 100).alias("metric"))


@query("early_stopping", """
WITH h AS (SELECT user_id, day(ts) AS epoch, avg(value) / 100 AS metric FROM events GROUP BY ALL),
a AS (SELECT *, row_number() OVER w AS pos,
             greatest(coalesce(max(metric) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS best
      FROM h WINDOW w AS (PARTITION BY user_id ORDER BY epoch)),
b AS (SELECT *, coalesce(max(CASE WHEN metric > best THEN pos END) OVER (PARTITION BY user_id ORDER BY pos), 0) AS last_pos FROM a),
s AS (SELECT user_id, min(pos) FILTER (pos - last_pos >= 5) AS stop, max(pos) AS n FROM b GROUP BY 1)
SELECT b.user_id, stop IS NOT NULL AS stopped_early, b.pos AS steps_run, CAST(b.epoch AS INTEGER) AS last_step,
       CAST(i.epoch AS INTEGER) AS best_step, round(i.metric, 7) AS best_value
FROM s JOIN b ON b.user_id = s.user_id AND b.pos = coalesce(s.stop, s.n)
LEFT JOIN b i ON i.user_id = b.user_id AND i.pos = b.last_pos
""")
def early_stopping(t):
    found = ordered.early_stopping(daily_history(t), "metric", "epoch", "user_id", 5, F.floor(F.col("epoch") / 7))
    return rounded(found, 7, "best_value")


@query("promote_version", """
WITH r AS (SELECT event_type AS name, CAST(user_id AS VARCHAR) AS version, avg(value) / 100 AS macro_f1 FROM events GROUP BY ALL)
SELECT name, max(CAST(version AS BIGINT)) AS version, round(arg_max(macro_f1, CAST(version AS BIGINT)), 7) AS macro_f1,
       count(*) AS accepted, 'production' AS alias FROM r WHERE macro_f1 >= 0.5 GROUP BY 1
""")
def promote_version(t):
    runs = t.events.groupBy(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("version")).agg(
        (F.avg("value") / 100).alias("macro_f1"))
    return rounded(evaluate.promote(runs, "name", "version", "macro_f1", 0.5), 7, "macro_f1")


@query("metric_long", f"""
WITH {_PER_CLASS}
SELECT 'test_f1_' || label AS key, round(f1, 4) AS value, CAST(3 AS BIGINT) AS step FROM f
""")
def metric_long(t):
    return evaluate.to_metric_rows(evaluate.per_class_f1(class_pairs(t), CLASS_NAMES), "label", "f1", "test_f1", 3)


@query("train_weighted")
def train_weighted(t):
    """Trained on four fifths of the vectors, scored on the others over all labels that the table has."""
    rows = t.embeddings.select("vec_id", "embedding", "label").withColumn("held", F.col("vec_id") % 5 == 0)
    model = scoring.train_weighted(row_weights(rows.where("not held"), "label"), "embedding", "label")
    fitted = scoring.predict(model, rows.where("held"), "embedding")
    pairs = evaluate.pair_counts(fitted, "label", "predicted")
    labels = [r["label"] for r in rows.select(F.col("label").cast("string").alias("label")).distinct().sort("label").collect()]
    return evaluate.report(pairs, labels)


@query("vector_mixup_checked", "SELECT vec_id, label AS label_a, true AS blended FROM embeddings")
def vector_mixup_checked(t):
    """Each mixed vector is the stated blend of its own and its partner's, with the partner's label."""
    mixed = scoring.vector_mixup(t.embeddings, "embedding", "label", "vec_id", alpha=0.4, share=0.5)
    own = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    other = t.embeddings.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("y"), F.col("label").alias("label_y"))
    both = mixed.join(own, "vec_id").join(other, "partner")
    blend = F.zip_with("x", "y", lambda x, y: F.col("lam") * x.cast("double") + (1 - F.col("lam")) * y.cast("double"))
    same = F.forall(F.zip_with("mixed", blend, lambda a, b: F.abs(a - b) < 1e-9), lambda ok: ok)
    return both.select("vec_id", "label_a", (same & F.col("lam").between(0, 1) & (F.col("label_b") == F.col("label_y"))).alias("blended"))


@query("nearest_rank_close", "SELECT DISTINCT event_type, true AS close FROM events")
def nearest_rank_close(t):
    """Is the sketch's value within its stated rank error of the exact rank?"""
    found = ranks.nearest_rank_approx(t.events, "value", 0.95, ["event_type"]).withColumnRenamed("value", "found")
    counted = t.events.join(F.broadcast(found), "event_type").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < F.col("found")).alias("below"), F.count_if(F.col("value") <= F.col("found")).alias("upto"))
    rank, error = (F.col("n") - 1) * 0.95, F.col("n") / 10_000 + 1
    return counted.select("event_type", ((F.col("below") <= rank + error) & (F.col("upto") >= rank - error)).alias("close"))


@query("serving_facts", f"""
WITH {_SCORED}
SELECT CAST(vec_id AS VARCHAR) AS prediction_id, predicted_class, round(confidence, 4) AS confidence,
       CASE predicted_class WHEN 'mel' THEN 'HIGH' WHEN 'bcc' THEN 'MEDIUM' WHEN 'akiec' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       round(vec_id * 1.5, 2) AS inference_ms, CASE WHEN vec_id % 3 > 0 THEN 'i' || vec_id || '.jpg' ELSE 'unknown.jpg' END AS filename,
       round(vec_id * 1000 / 1024.0, 2) AS image_size_kb, label AS uid FROM c
""")
def serving_facts(t):
    """Scored requests as the two stored tables of a service, joined by image."""
    requests = logits(t).select(
        F.col("vec_id").cast("string").alias("prediction_id"), F.col("label").alias("uid"), F.lit("u").alias("username"),
        F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("i"), "vec_id", F.lit(".jpg"))).alias("image_filename"),
        (F.col("vec_id") * 1000).alias("image_bytes"), (F.col("vec_id") * 1.5 / 1000).alias("inference_s"),
        F.timestamp_seconds("vec_id").alias("timestamp"), "logits")
    facts = serving.prediction_facts(requests)
    images = serving.image_rows(facts).select("image_id", "filename", "image_size_kb")
    rows = serving.prediction_rows(facts).select(
        "prediction_id", "predicted_class", "confidence", "risk_level", "inference_ms", "image_id", "uid")
    return rounded(rows.join(images, "image_id").drop("image_id"), 2, "inference_ms", "image_size_kb")


@query("nearest_rank_pct", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value FROM r WHERE pos = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)
""")
def nearest_rank_pct(t):
    return ranks.nearest_rank(t.events, "value", 0.95, ["event_type"])


@query("nearest_rank_all", """
WITH r AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) - 1 AS pos, count(*) OVER () AS n FROM lineitem)
SELECT value FROM r WHERE pos = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)
""")
def nearest_rank_all(t):
    return ranks.nearest_rank(t.lineitem, "l_extendedprice", 0.95)


@query("nearest_rank_sketch")
def nearest_rank_sketch(t):
    return ranks.nearest_rank_approx(t.events, "value", 0.95, ["event_type"])


EPOCHS, RATE, DECAY, SMOOTHING = 4, 0.05, 1e-4, 0.1


def _training_sql() -> str:
    """The epochs of `train_epochs` as a chain of subqueries, ending in `history`."""
    parts = ["""
x AS (SELECT vec_id, label AS y, vec_id % 5 = 0 AS held, list_append(list_transform(embedding, lambda v: v::DOUBLE), 1.0::DOUBLE) AS f FROM embeddings),
cw AS (SELECT label AS k, round(sum(n) OVER () / (count(*) OVER () * n), 4)::DOUBLE AS w FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1)),
tot AS (SELECT count(*) AS k, sum(w) AS w FROM cw),
long AS (SELECT vec_id, y, unnest(f) AS v, generate_subscripts(f, 1) AS j FROM x WHERE NOT held),
w0 AS (SELECT k, j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM cw, (SELECT DISTINCT j FROM long))"""]
    for e in range(1, EPOCHS + 2):
        lr = f"({RATE}::DOUBLE * (1 + cos(pi() * {e - 1} / {EPOCHS})) / 2)"
        parts.append(f"""
z{e} AS MATERIALIZED (SELECT vec_id, y, held, k, list_dot_product(f, wv) AS z FROM x, (SELECT k, list(w ORDER BY j) AS wv FROM w{e - 1} GROUP BY k)),
q{e} AS MATERIALIZED (SELECT *, exp(z - t) / sum(exp(z - t)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS t FROM z{e})),
l{e} AS (SELECT vec_id, any_value(y) AS y, any_value(held) AS held, sum(CASE WHEN q.k = y THEN {1 - SMOOTHING} * cw.w * -ln(p) ELSE 0 END + {SMOOTHING} / tot.k * cw.w * -ln(p)) AS loss,
         sum(CASE WHEN q.k = y THEN cw.w END) AS own, arg_max(q.k, (p, -q.k)) AS guess FROM q{e} q JOIN cw USING (k), tot GROUP BY vec_id),
f{e} AS (SELECT held, avg(f1) AS f1 FROM (SELECT held, k, 2.0 * sum(hit) / sum(n) AS f1 FROM (
           SELECT held, y AS k, 1 AS n, (y = guess)::INTEGER AS hit FROM l{e} UNION ALL SELECT held, guess, 1, 0 FROM l{e}) GROUP BY ALL) GROUP BY 1),
s{e} AS (SELECT held, sum(loss) / sum(own) AS loss, sum(own) AS own, avg((y = guess)::INTEGER) AS accuracy, any_value(f1) AS f1 FROM l{e} JOIN f{e} USING (held) GROUP BY held),
g{e} AS MATERIALIZED (SELECT c.k, j, sum(c.c * v) / (SELECT own FROM s{e} WHERE NOT held) AS g FROM (
    SELECT vec_id, q.k, {1 - SMOOTHING} * own * (p - (q.k = q.y)::INTEGER) + {SMOOTHING} / tot.k * (p * tot.w - cw.w) AS c
    FROM q{e} q JOIN cw USING (k) JOIN l{e} l USING (vec_id), tot WHERE NOT q.held) c JOIN long USING (vec_id) GROUP BY ALL),
w{e} AS MATERIALIZED (SELECT k, j, w * (1 - {lr} * {DECAY}) - {lr} * (m / (1 - 0.9 ** {e})) / (sqrt(v / (1 - 0.999 ** {e})) + 1e-8) AS w, m, v
    FROM (SELECT k, j, w, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM w{e - 1} JOIN g{e} USING (k, j)))""")
    rows = [f"""SELECT {e} AS epoch, round({RATE}::DOUBLE * (1 + cos(pi() * {e - 1} / {EPOCHS})) / 2, 6) AS learning_rate, round(a.loss, 6) AS train_loss, round(b.loss, 6) AS val_loss,
       round(a.f1, 6) AS train_macro_f1, round(b.f1, 6) AS val_macro_f1, round(b.accuracy, 6) AS val_accuracy FROM s{e} a, s{e + 1} b WHERE NOT a.held AND b.held""" for e in range(1, EPOCHS + 1)]
    return ",".join(parts) + ",\nhistory AS (" + "\nUNION ALL ".join(rows) + ")"


def trained(t):
    """Trained on four fifths of the vectors, over all labels that these have, with balanced class weights."""
    rows = t.embeddings.withColumn("held", F.col("vec_id") % 5 == 0)
    weights = class_weights(class_distribution(rows.where("not held"), "label"), "label").where("label is not null").collect()  # one row per class
    named = {str(r["label"]): r["weight"] for r in weights}
    classes = sorted(named, key=int)
    return training.train_epochs(rows, "embedding", "label", "held", classes, named, EPOCHS, RATE, DECAY, SMOOTHING)


@query("training_history", f"WITH {_training_sql()} SELECT * FROM history")
def training_history(t):
    found = trained(t).table(t.spark, "r1").drop("run")
    return rounded(found, 6, *[c for c in found.columns if c != "epoch"])


@query("training_outcome", f"""
WITH {_training_sql()}
SELECT 'r1' AS run, false AS stopped_early, count(*) AS steps_run, max(epoch) AS last_step, arg_max(epoch, (val_macro_f1, -epoch)) AS best_step,
       max(val_macro_f1) AS best_value, max(val_macro_f1) >= 0.05 AS accepted FROM history
""")
def training_outcome(t):
    """The epochs' own macro F1 goes through early stopping, and the best value through the acceptance gate."""
    history = trained(t).table(t.spark, "r1")
    ends = ordered.early_stopping(history, "val_macro_f1", "epoch", "run")
    gate = evaluate.promote(ends.withColumn("version", F.lit(1)), "run", "version", "best_value", 0.05).select("run", F.lit(True).alias("accepted"))
    found = ends.join(gate, "run", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return rounded(found, 6, "best_value")
