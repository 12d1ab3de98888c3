"""Quality rules: minimum-covariance-determinant estimates per language and source.

Each text becomes counts, the counts a vector of transformed statistics. Per cell (language and source) a minimum
covariance determinant estimate is found by concentration steps from two fixed starts; texts whose robust Mahalanobis
distance lies beyond a chi-square quantile are rejected.

Defined results: a null text has no words. Null languages and sources are cells of their own. Cells below `min_rows`
rows are pooled by language, then all together; a pool below `min_rows` rejects nothing. Repeated rows count as often
as they stand. Of two starts with equal determinants the first counts; the nearest rows are taken by whole distance
buckets, and the correction for the core's size uses the share really taken. Rows that fail the base rules take no part in the estimates. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import checked_broadcast, durable, query, small_batches

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, "n_borders")])
#: A statistic is kept as an integer of this many steps, so that all moments are exact sums.
STEPS = 256
#: Smallest standard deviation that an estimate can have, by statistic (see vector()).
FLOORS = (0.5, 0.05, 0.5, 0.5, 0.5, 0.5)
P = len(FLOORS)
CORE_SHARE = 0.75
CUTOFF_P = 1 - 1e-6
MIN_ROWS = 50
C_STEPS = 8
_BLANKS = " \t\n\v\f\r"


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside a window of `width` words that stands in the text twice or more; names double in length, so they are exact."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    name = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    span = 1
    while span < width:
        pair = name[:-span] * (int(name.max()) + 1) + name[span:]
        name = np.unique(pair, return_inverse=True)[1]
        span *= 2
    again = np.bincount(name)[name] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(raw) - len(raw.translate(None, b"!?;:=_/\\{}[]()@~^`\""))
    return (
        len(words), len(text) - sum(text.count(c) for c in _BLANKS), sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words), upper, marks,
    )


def borders(text: str | None) -> int:
    """Vertical bars that stand alone: the cell borders of tables in plain text, layout and not noise."""
    return text.encode().split().count(b"|") if text and "|" in text else 0


@F.pandas_udf(STATS)
def count_text(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([(*text_counts(t), borders(t)) for t in part], columns=STATS.names, dtype="int64")


def with_counts(docs: DataFrame, into: str) -> DataFrame:
    # a plan may not run the pass over the text twice, for a filter and for its columns
    return small_batches(docs).withColumn(into, count_text.asNondeterministic()(F.col("text")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Transformed statistics; twenty neutral words are added so that short texts do not scatter.

    Cell borders are neither words nor symbols here: a table differs from prose in layout, not in quality."""
    n = s["n_words"] - s["n_borders"] + 20
    share = [F.log1p(100.0 * c / n) for c in (s["n_symbols"] - s["n_borders"], s["n_upper"], s["n_marks"], s["n_repeat_words"])]
    plain = [F.log(n - 19.0), F.log((s["word_chars"] - s["n_borders"] + 100.0) / n), *share]
    return [F.round(x * STEPS).cast("long") for x in plain]


def chi2_quantile(p: float, dof: int) -> float:
    """For even degrees of freedom, from the closed form of the distribution."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def chi2_cdf(x: float, dof: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(share: float) -> float:
    """What a normal core's covariance falls short of the whole's, as a factor of squared distances."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1.0


def _distance(x: list[Column], at: Column, inverse: Column) -> Column:
    d = [x[i] / F.lit(float(STEPS)) - at[i] for i in range(P)]
    return sum((d[i] * d[j] * inverse[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _estimate(n: float, first: np.ndarray, second: np.ndarray) -> tuple[list[float], list[float], float]:
    at = first / n / STEPS
    cov = second / n / STEPS**2 - np.outer(at, at) + np.diag(np.square(FLOORS))
    return at.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


_FOUND = "cell_lang string, cell_source string, start int, n long, core long, spread double, at array<double>, inverse array<double>, logdet double"
_CELL = ["cell_lang", "cell_source", "start"]


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a cell, summed by distance: moments of the nearest buckets that hold the core share."""
    pdf = pdf.sort_values("bucket")
    held = pdf["n"].cumsum().to_numpy()
    stop = int(np.searchsorted(held, math.ceil(CORE_SHARE * held[-1]))) + 1
    core = pdf.iloc[:stop]
    first = np.array([float(core[f"s{i}"].sum()) for i in range(P)])
    second = np.array([[float(core[f"s{min(i, j)}_{max(i, j)}"].sum()) for j in range(P)] for i in range(P)])
    n = int(core["n"].sum())
    key = [pdf[c].iloc[0] for c in _CELL]
    return pd.DataFrame([[*key, int(held[-1]), n, consistency(n / int(held[-1])), *_estimate(n, first, second)]], columns=[
        *_CELL, "n", "core", "spread", "at", "inverse", "logdet"])


def _cells(stats: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) -> cell; a cell without name pools the small ones."""
    n = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    name = lambda c: F.concat(F.lit("="), F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")))  # noqa: E731  null is a name
    n = n.withColumns({
        "cell_source": F.when(F.col("n") >= min_rows, name("source")).otherwise("*"),
        "cell_lang": name("lang"),
    })
    pool = n.groupBy("cell_lang", "cell_source").agg(F.sum("n").alias("pooled"))
    n = n.join(pool, ["cell_lang", "cell_source"])
    return n.select("lang", "source", F.when(F.col("pooled") >= min_rows, F.col("cell_lang")).otherwise("*").alias("cell_lang"), "cell_source")


def _by_group(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """Left join on language and source where null equals null."""
    right = right.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    both = left["lang"].eqNullSafe(right["__lang"]) & left["source"].eqNullSafe(right["__source"])
    return left.join(checked_broadcast(right, rows), both, "left").drop("__lang", "__source")


def estimates(stats: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, spread, at, inverse) from rows (lang, source, s); the result is a written table, one row per pair."""
    rows = stats.filter(~base_failed(F.col("s"))).select("lang", "source", *[x.alias(f"x{i}") for i, x in enumerate(vector(F.col("s")))])
    cells = durable(_cells(rows, min_rows))
    n_cells = cells.count()
    # equal vectors are one row with a weight, which also makes the steps cheap
    rows = _by_group(rows, cells, n_cells).groupBy("cell_lang", "cell_source", *[f"x{i}" for i in range(P)]).agg(F.count("*").alias("n"))
    rows = durable(rows)
    moments = [F.sum("n").alias("n")]
    moments += [F.sum(F.col("n") * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)]
    moments += [F.sum((F.col("n") * F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")).cast("double").alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    x = [F.col(f"x{i}") for i in range(P)]

    def step(placed: DataFrame) -> DataFrame:
        summed = placed.groupBy(*_CELL, "bucket").agg(*moments)
        return durable(summed.groupBy(*_CELL).applyInPandas(_concentrate, _FOUND))

    # first start: medians and quartile ranges by coordinate; second: the coordinate-wise middle half
    half = rows.groupBy("cell_lang", "cell_source").agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias(f"q{i}") for i in range(P)])
    first = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * STEPS), F.lit(FLOORS[i])) for i in range(P)]
    off = [(x[i] - F.col(f"q{i}")[1]) / (STEPS * first[i]) for i in range(P)]
    near = [sum((o * o for o in off), F.lit(0.0)), F.greatest(*[F.abs(o) for o in off]) ** 2]
    placed = rows.join(checked_broadcast(half, n_cells), ["cell_lang", "cell_source"])
    placed = placed.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), _bucket(d).alias("bucket")) for k, d in enumerate(near)])).alias("e")).select("*", "e.*")
    found = step(placed)
    for _ in range(C_STEPS):
        placed = rows.join(checked_broadcast(found.drop("n"), 2 * n_cells), ["cell_lang", "cell_source"])
        found = step(placed.withColumn("bucket", _bucket(_distance(x, F.col("at"), F.col("inverse")))))
    best = found.groupBy("cell_lang", "cell_source").agg(
        F.min(F.struct("logdet", "start", "n", "spread", "at", "inverse")).alias("b")).select("cell_lang", "cell_source", "b.n", "b.spread", "b.at", "b.inverse")
    out = cells.join(best.filter(F.col("n") >= min_rows).drop("n"), ["cell_lang", "cell_source"])
    return durable(out.select("lang", "source", "spread", "at", "inverse"))


def _bucket(d2: Column) -> Column:
    return F.floor(16 * F.log2(F.least(d2, F.lit(1e9)) + 1 / 64)).cast("int")


def judged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds `d2` (squared robust distance, null without estimate), `base_failed` and `kept` to rows that have counts in `s`."""
    limit = chi2_quantile(CUTOFF_P, P) * F.col("spread")
    rows = _by_group(docs, found, found.count())
    rows = rows.withColumn("d2", _distance(vector(F.col("s")), F.col("at"), F.col("inverse"))).drop("at", "inverse")
    rows = rows.withColumn("base_failed", base_failed(F.col("s")))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))).drop("spread")


def keep_inliers(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their columns as they are."""
    wide = docs.select(F.struct("*").alias("row"), "lang", "source", "text")
    wide = durable(with_counts(wide, "s").drop("text"))  # counted once, as counting costs more than a copy of the texts
    return judged(wide, estimates(wide.select("lang", "source", "s"))).filter("kept").select("row.*")


@query("op1_quality")
def _op1(table):
    stats = durable(with_counts(table("documents").select("doc_id", "lang", "source", "text"), "s").drop("text"))
    out = judged(stats, estimates(stats.select("lang", "source", "s")))
    return out.select("doc_id", *[F.col("s")[c].alias(c) for c in COUNTS[:5]], "base_failed", "kept", "d2")
