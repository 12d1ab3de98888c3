"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def strip(text: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise(text: str | Column) -> Column:
    return F.lower(strip(text))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is zero."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def clamp_min(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(float(floor)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(safe_ratio(part * 100.0, whole), digits)


def kilobytes(size: str | Column) -> Column:
    return col(size) / F.lit(1024.0)


def join_path(*parts: str | Column, suffix: str = "") -> Column:
    """Folder/file path from literals (plain strings) and columns, with an optional file suffix."""
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    if suffix:
        pieces[-1] = F.concat(pieces[-1], F.lit(suffix))
    return F.concat_ws("/", *pieces)


def labels_match(labels: Column, matchers: Mapping[str, str]) -> Column:
    """True where every label matches its pattern in full; a missing label counts as empty."""
    found = F.lit(True)
    for key, pattern in matchers.items():
        found = found & F.coalesce(labels[key], F.lit("")).rlike(f"^(?:{pattern})$")
    return found


def doubles(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def exp_shifted(vector: Column) -> Column:
    """exp of each score after subtracting the largest, so that no score overflows."""
    return F.transform(vector, lambda x: F.exp(x - F.array_max(vector)))


def argmax(vector: Column) -> Column:
    """0-based position of the largest value, first on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def named_scores(names: Sequence[str], vector: Column, digits: int = 4) -> Column:
    return F.map_from_arrays(strings(names), F.transform(vector, lambda x: F.round(x, digits)))


def ranked(scores: Column) -> Column:
    """Map entries as an array, highest value first, key breaking ties."""
    return F.array_sort(
        F.map_entries(scores),
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1)
        .when(a["key"] > b["key"], 1)
        .otherwise(0),
    )


def histogram_quantile(q: float, bounds: Sequence[float], cumulative: Column) -> Column:
    """Quantile from cumulative bucket counts, one per finite bound and the last one for +Inf.

    Linear inside the bucket, the first bucket starts at zero, the open bucket answers with the last
    finite bound, no observations give null.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must lie in [0, 1]")
    limits = doubles(bounds)
    total = F.element_at(cumulative, -1)
    rank = F.lit(q) * total
    place = F.array_position(F.transform(cumulative, lambda n: n >= rank), True).cast("int") - 1
    first = place == 0
    high = F.get(limits, place)
    low = F.when(first, F.lit(0.0)).otherwise(F.get(limits, place - 1))
    below = F.when(first, F.lit(0)).otherwise(F.get(cumulative, place - 1))
    held = F.get(cumulative, place) - below
    inside = F.when(held > 0, low + (high - low) * (rank - below) / held).otherwise(low)
    return F.when(
        total > 0,
        F.when(place == len(bounds), F.lit(float(bounds[-1])))
        .when(first & (high <= 0), high)
        .otherwise(inside),
    )


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 (the session runs in UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def whole_steps(value: Column, width: Column | int) -> Column:
    """Integer division of two whole numbers, rounded down for negative ones too."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.call_function("div", value - F.pmod(value, width), width)


def grid_index(ts: str | Column, step: int) -> Column:
    """Number of the first grid point at or after `ts`; grid points are multiples of `step` seconds."""
    width = step * 1_000_000
    return whole_steps(micros(ts) + F.lit(width - 1), width)


def grid_time(index: Column, step: int) -> Column:
    return from_micros(index * F.lit(step * 1_000_000))
