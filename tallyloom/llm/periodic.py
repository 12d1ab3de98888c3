"""Periodic run detection: stretches of words that repeat with a period, found by tiles of each period octave.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that neither neighbour
extends. Words that equal the word q places on form match intervals; a run is one of at least 3 q places. Octave k holds
the periods P = 2^k to 2 P - 1 and has a boundary every P words, so that each such interval contains boundaries and is
the union of what is seen around them. At a boundary b the Z-function of the words after it gives for each period how far
the words from b and from b + q agree, that of the reversed words before it the same to the left, both up to P words.
Octaves below 64 compute these Z-values for all boundaries in step, word by word. In larger ones a pair (b, q) counts only
if it agrees over P words on one side, so boundaries at which no period agrees over 16 are passed over, and linear Z-functions serve the rest.

Documents of up to TILE words are one tile for all octaves. Longer ones are exploded into overlapping tiles, one set for
the small octaves and one for each larger octave with tiles that grow with the period; tiles are dealt to tasks anew.
Fragments of intervals are shuffled by document and period and stitched where they touch. An interval with a shorter
period that divides q has the same ends, so the least period of equal ends is the smallest one.

Defined results: a null or empty text has no words and no runs. Repeated rows and repeated or null ids are solved each for
itself. A text of any length is one row and never cut; its tiles go to different tasks. Among runs of equal
length / period the smallest start wins, then the smallest period. An empty table gives an empty result, extra columns
are left out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, query, small_batches

#: Words of a tile's core for small octaves; larger octaves have cores of 8 periods.
TILE = 16_384
#: Small octaves are those up to this period.
SMALL = TILE // 16
#: Below this period all Z-values of an octave are computed in step.
IN_STEP = 64
SCREEN = 16
#: Words of short documents that are solved as one array.
SIDE_BY_SIDE = 1 << 16

Reading = Callable[[int | None, str | None], list[bytes]]


def plain_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """Words between blanks; splitting bytes knows exactly the blanks 0x20 and 0x09 to 0x0D."""
    return (text or "").encode().split()


def stretched_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text, of which one in ten (by id) repeats a part of it to its end; without an id none does."""
    words = plain_words(doc_id, text)
    g, stays = divmod(zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, 10)
    n = len(words)
    if stays or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[:n - a]


def z_function(s: np.ndarray) -> np.ndarray:
    """z[i]: how many items from i on equal those from 0 on. Only places that hold the first item are visited."""
    n = len(s)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    z[0] = n
    items, left, right = s.tolist(), 0, 0
    for i in np.flatnonzero(s[1:] == s[0]).tolist():
        i += 1
        k = min(right - i, int(z[i - left])) if i < right else 0
        if i + k >= right:
            while i + k < n and items[k] == items[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def boundary_extensions(a: np.ndarray, b: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) agreement at boundary `b` for the periods p to 2 p - 1, each at most p, from two Z-functions."""
    after = z_function(a[b:b + 3 * p])[p:2 * p]
    right = np.zeros(p, np.int64)
    right[:len(after)] = np.minimum(after, p)
    head = a[max(0, b - p):b][::-1]
    body = a[max(0, b - p):b + 2 * p][::-1]  # its item at place e - q is the word before b + q
    z = z_function(np.concatenate([head, [np.iinfo(np.int64).min], body]))[len(head) + 1:]
    ends = min(len(a), b + 2 * p) - b - np.arange(p, 2 * p)
    left = np.where(ends >= 0, z[np.maximum(ends, 0)], 0)
    return left, right


def _in_step(a: np.ndarray, at: np.ndarray, other: np.ndarray, way: int, most: int) -> np.ndarray:
    """For pairs of places in `a` (padded with unequal items) how many items agree from there on, up to `most`."""
    agree = np.zeros(len(at), np.int32)
    alive = np.flatnonzero(a[at] == a[other])
    for step in range(1, most + 1):
        agree[alive] = step
        if step == most or not len(alive):
            break
        alive = alive[a[at[alive] + way * step] == a[other[alive] + way * step]]
    return agree


def fragments(ids: np.ndarray, low: int, high: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, lo, hi) of match intervals as far as boundaries in [first, last) see them, joined where they touch.

    `ids` are the words of a tile; intervals that lie inside and are too short for a run are left out."""
    found = []
    margin = 2 * SCREEN + 4 * IN_STEP
    pads = -2 - np.arange(2 * margin)
    a = np.concatenate([pads[:margin], ids.astype(np.int64), pads[margin:]])
    n = len(ids)
    for k in range(low, high + 1):
        p = 1 << k
        bounds = np.arange(first, min(last, n), p)
        most = p if p < IN_STEP else SCREEN
        for some in np.array_split(bounds, max(1, len(bounds) * p >> 20)):
            if not len(some):
                continue
            b = np.repeat(some, p)
            q = np.tile(np.arange(p, 2 * p), len(some))
            inside = b + q <= n  # at n only words to the left can agree
            b, q = b[inside], q[inside]
            at = b + margin
            right = _in_step(a, at, at + q, 1, most)
            left = _in_step(a, at - 1, at + q - 1, -1, most)
            if p >= IN_STEP:
                repeated = np.unique(b[(left == most) | (right == most)])
                parts = [(c, *boundary_extensions(ids, int(c), p)) for c in repeated]
                b = np.repeat(repeated, p)
                q = np.tile(np.arange(p, 2 * p), len(repeated))
                left = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.int64)
                right = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.int64)
            keep = np.flatnonzero((left >= p) | (right >= p) | (left + right >= np.maximum(3 * q, 6 - q)))
            if len(keep):
                found.append((q[keep], b[keep] - left[keep], b[keep] + right[keep]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    q, lo, hi = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    order = np.lexsort((hi, lo, q))
    q, lo, hi = q[order], lo[order], hi[order]
    begins = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (lo[1:] > hi[:-1])]))
    q, lo, hi = q[begins], lo[begins], np.maximum.reduceat(hi, begins)
    octave = np.int64(1) << np.floor(np.log2(q)).astype(np.int64)
    final = first + (min(last, n) - 1 - first) // octave * octave
    opened = ((first > 0) & (lo <= first - octave)) | ((last < n) & (hi >= final + octave))
    keep = opened | (hi - lo >= np.maximum(3 * q, 6 - q))
    return q[keep], lo[keep], hi[keep]


def tiles(n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(low octave, high octave, first boundary, end of boundaries, first word, end of words) of the tiles of `n` words."""
    top = (n // 4).bit_length() - 1
    small = min(top, SMALL.bit_length() - 1)
    for low, high, core in [(0, small, TILE), *((k, k, max(TILE, 8 << k)) for k in range(small + 1, top + 1))]:
        reach = 1 << high
        for c in range(0, n, core):
            yield low, high, c, min(n, c + core), max(0, c - reach), min(n, c + core + 3 * reach)


def word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Numbers of words; equal numbers are equal words."""
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


_SCANNED = ("row long, doc_id long, whole string, text string, period long, lo long, hi long, "
            "low int, high int, first long, last long, base long, ids binary")
_COLUMNS = [c.split()[0] for c in _SCANNED.split(", ")]


def _frame(**columns) -> pd.DataFrame:
    made = pd.DataFrame(columns)
    whole = {"row", "doc_id", "period", "lo", "hi", "low", "high", "first", "last", "base"}
    for c in _COLUMNS:
        if c not in made:
            made[c] = pd.array([pd.NA] * len(made), "Int64") if c in whole else None
    return made[_COLUMNS]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(reading: Reading) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of three kinds: documents (their text only where runs are possible), fragments, and tiles of long documents."""
    def solved(side: list[tuple[int, int | None, str | None, list[bytes]]]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        parts, starts, at = [], [], 0
        for i, (*_, words) in enumerate(side):
            starts.append(at)
            parts += [word_ids(words, known), np.array([-2_000_000_000 + i], np.int32)]  # a unique item ends each document
            at += len(words) + 1
        rows = np.array([s[0] for s in side], np.int64)
        starts = np.array(starts, np.int64)
        longest = max(len(s[3]) for s in side)
        q, lo, hi = fragments(np.concatenate(parts), 0, max(0, (longest // 4).bit_length() - 1), 0, at)
        of = np.searchsorted(starts, lo, "right") - 1
        has = np.isin(np.arange(len(side)), of)
        yield _frame(row=rows, doc_id=pd.array([s[1] for s in side], "Int64"), whole=[_digest(s[3]) for s in side],
                     text=[s[2] if h else None for s, h in zip(side, has.tolist(), strict=True)])
        if len(q):
            yield _frame(row=rows[of], period=q, lo=lo - starts[of], hi=hi - starts[of])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side, held = [], 0
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for row, doc_id, text in zip(batch["row"], ids, batch["text"], strict=True):
                words = reading(doc_id, text)
                if len(words) <= TILE:
                    side.append((row, doc_id, text, words))
                    held += len(words) + 1
                    if held >= SIDE_BY_SIDE:
                        yield from solved(side)
                        side, held = [], 0
                    continue
                yield _frame(row=[row], doc_id=pd.array([doc_id], "Int64"), whole=[_digest(words)], text=[text])
                numbers = word_ids(words, {})
                for low, high, first, last, base, end in tiles(len(words)):
                    yield _frame(row=[row], low=[low], high=[high], first=[first], last=[last], base=[base],
                                 ids=[numbers[base:end].tobytes()])
        if side:
            yield from solved(side)
    return run


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments of the tiles of long documents."""
    for batch in batches:
        for t in batch.itertuples():
            ids = np.frombuffer(t.ids, np.int32)
            q, lo, hi = fragments(ids, t.low, t.high, t.first - t.base, t.last - t.base)
            yield pd.DataFrame({"row": np.full(len(q), t.row, np.int64), "period": q, "lo": lo + t.base, "hi": hi + t.base})


def stitched(parts: DataFrame) -> DataFrame:
    """(row, start, length, period) of runs from fragments (row, period, lo, hi) that touch or overlap."""
    ordered = Window.partitionBy("row", "period").orderBy("lo", "hi")
    reached = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("lo") > F.coalesce(reached, F.lit(-1))).cast("int")
    joined = parts.withColumn("begins", begins).withColumn("island", F.sum("begins").over(ordered)) \
        .groupBy("row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi")) \
        .withColumn("length", F.col("hi") - F.col("start") + F.col("period")) \
        .filter("length >= greatest(6, 4 * period)")
    return joined.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def scan(docs: DataFrame, reading: Reading = plain_words) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): rows (row, doc_id, whole, text) with the digest of all words, the text only where runs are
    possible, and runs (row, start, length, period). `docs` has doc_id and text."""
    rows = small_batches(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scanned = durable(rows.mapInPandas(_scan(reading), _SCANNED))
    large = scanned.filter("ids IS NOT NULL").select("row", "low", "high", "first", "last", "base", "ids")
    parts = scanned.filter("period IS NOT NULL").select("row", "period", "lo", "hi").unionByName(
        large.repartition(F.xxhash64("row", "low", "first")).mapInPandas(_solve, "row long, period long, lo long, hi long"))
    return scanned.filter("whole IS NOT NULL").select("row", "doc_id", "whole", "text"), stitched(parts)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run (start, length, period) holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _collapsed(reading: Reading) -> Callable[..., Column]:
    @F.pandas_udf("collapsed string, collapsed_sha256 string, runs_sha256 string")
    def collapse(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for doc_ids, texts, starts, lengths, periods in parts:
            out = []
            for doc_id, text, *found in zip(doc_ids, texts, starts, lengths, periods, strict=True):
                runs = list(zip(*([] if f is None else [int(x) for x in f] for f in found), strict=True))
                kept = b" ".join(kept_words(reading(None if pd.isna(doc_id) else int(doc_id), text), runs))
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
                out.append((kept.decode(), hashlib.sha256(kept).hexdigest(), hashlib.sha256(lines.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["collapsed", "collapsed_sha256", "runs_sha256"])
    return collapse


def collapsed(docs: DataFrame, reading: Reading = plain_words) -> DataFrame:
    """(doc_id, n_runs, runs, collapsed, collapsed_sha256, runs_sha256) per row.

    `runs` are structs (start, period, length) by start, then period. `collapsed` is the text of the kept words joined by
    one space; it is null where no run is possible, as the text then stands as it is."""
    rows, runs = scan(docs, reading)
    grouped = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    plain = rows.filter("text IS NULL").select(
        "doc_id", F.lit(None).cast("array<struct<start:bigint,period:bigint,length:bigint>>").alias("runs"),
        F.lit(None).cast("string").alias("collapsed"), F.col("whole").alias("collapsed_sha256"), none.alias("runs_sha256"))
    mixed = rows.filter("text IS NOT NULL").join(grouped, "row", "left")
    made = mixed.select("doc_id", "runs", _collapsed(reading)("doc_id", "text", "runs.start", "runs.length", "runs.period").alias("c")) \
        .select("doc_id", "runs", "c.*")
    return plain.unionByName(made).select("doc_id", F.greatest(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
                                          "runs", "collapsed", "collapsed_sha256", "runs_sha256")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared as exact fractions; null without runs."""
    def better(best: Column, run: Column) -> Column:
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>"), better)


@query("op11_runs")
def _op11(table):
    found = collapsed(table("documents"), stretched_words).withColumn("best", strongest("runs"))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
