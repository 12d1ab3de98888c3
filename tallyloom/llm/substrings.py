"""Repeated byte strings: sampled suffixes are named and sorted out, the remaining ones follow from their sample.

The sample is a content-defined difference cover: of the 32-byte strings inside each 100-byte string the one with the
smallest hash, the first of equals. Every 100-byte string thus has a sampled place and equal ones have it at the same
distance, so they meet in the group of the sampled string, and only sampled places (one in 32 bytes), not all suffixes,
are shuffled. The starts that share a sampled place form a run. First equal runs are found by name; of each name the
earliest stays a candidate, all later ones are repeats as a whole. Where a sampled string has runs of several names, the
strings of the candidates are sorted: triples of eight bytes get names, triples of names get names again, and neighbours in
the order with equal prefixes of LENGTH bytes are repeats. Names of runs, and of strings compared between salted tasks, are
64-bit hashes. A fixed cover modulo three has to move two of three suffixes in every round, which does not fit (README).

A repeat is a `LENGTH`-byte string that also starts earlier: in a document with a smaller doc_id, or earlier in the same.

Defined results: a null text is empty. Rows without doc_id come first, rows of one doc_id are ordered by a hash of the
text; rows that are equal in id and text are one document and get the same result each. Texts below LENGTH bytes keep
all. An empty table gives an empty result."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, durable, query, small_batches

LENGTH = 100
SEED = 32  # a power of two
#: Bytes of a text that are looked at at once; parts overlap by LENGTH - 1.
_PART = 1 << 20
#: Candidates of one sampled string that a task compares; more are salted.
GROUP = 500
#: Candidates of one comparing task.
TASK_RUNS = 12_000
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes, put together from powers of two."""
    h, span, power = data.astype(np.uint64) + np.uint64(1), 1, _ODD
    out, done = None, 0
    n = len(data) - width + 1
    while True:
        if width & span:
            part = h[done:done + n]
            out = part if out is None else out * np.uint64(power) + part
            done += span
        if done == width:
            break
        h = h[:-span] * np.uint64(power) + h[span:]
        power = power * power & _WRAP
        span *= 2
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def runs(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, first start, last start) of the runs of a text, part by part."""
    step = _PART - LENGTH + 1
    reach = LENGTH - SEED + 1
    for at in range(0, max(1, len(data) - LENGTH + 1), step):
        part = np.frombuffer(data[at:at + _PART], np.uint8)
        if len(part) < LENGTH:
            return
        z = rolling(part, SEED)
        low = (z >> np.uint64(20) << np.uint64(20)) | np.arange(len(z), dtype=np.uint64)
        span = 1
        while 2 * span <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < reach:
            low = np.minimum(low[:span - reach], low[reach - span:])
        place = (low & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        yield z[place[first]].view(np.int64), first + at, last + at


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(batch.column("text")):
        if text.is_valid:
            yield i, text.as_buffer().to_pybytes()


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [seed for _, data in _texts(batch) for seed, _, _ in runs(data)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["seed"])


def _named_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows = []
        for i, data in _texts(batch):
            for seed, first, last in runs(data):
                names = np.array([name(data[a:b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64).view(np.int64)
                rows.append((seed, names, np.full(len(seed), i), first, last))
        if rows:
            seed, names, at, first, last = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed), pa.array(names), batch.column("doc").take(pa.array(at)), batch.column("hash").take(pa.array(at)),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["seed", "name", "doc", "hash", "first", "last"])


_RUN = "seed long, name long, doc long, hash long, first int, last int"
_STRINGS = "seed long, salts int, doc long, hash long, first int, data binary"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each candidate run of the documents."""
    for batch in batches:
        data = {i: x for i, x in _texts(batch)}
        rows: dict[str, list] = {"seed": [], "salts": [], "doc": [], "hash": [], "first": [], "data": []}
        for i, (doc, hash_, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "runs")), strict=True)):
            for r in found:
                rows["seed"].append(r["seed"])
                rows["salts"].append(r["salts"])
                rows["doc"].append(doc)
                rows["hash"].append(hash_)
                rows["first"].append(r["first"])
                rows["data"].append(data[i][r["first"]:r["last"] + LENGTH])
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))


_STARTS = "doc long, hash long, first int, last int, seed long, name long, open boolean"


def _ranked(*names: np.ndarray) -> np.ndarray:
    """Sorts tuples of names and numbers them in order."""
    key = names[0].astype(np.int64)
    for name in names[1:]:
        base = int(name.max()) + 1
        if (int(key.max()) + 1) * base >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + name
    return np.unique(key, return_inverse=True)[1]


def prefix_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers, in order, of the LENGTH-byte strings at the places: triples are sorted, their names are sorted in triples again."""
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | data[i:i + len(eight)].astype(np.uint64)
    name, width = np.unique(eight, return_inverse=True)[1], 8
    while 3 * width <= LENGTH:
        n = len(name) - 2 * width
        name = _ranked(name[:n], name[width:width + n], name[2 * width:])
        width *= 3
    shift = LENGTH - width  # the last two overlap
    return _ranked(name[at], name[at + shift])


def _compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of starts that are repeats among the candidates of the task; of salted groups also the earliest start of each name."""
    frames = list(parts)  # at most some TASK_RUNS runs
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True)
    size = pdf["data"].map(len).to_numpy()
    whole = np.frombuffer(b"".join(pdf["data"]), np.uint8)
    if not len(whole):
        return
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size - LENGTH + 1)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1), size - LENGTH + 1)
    at = (ends - size)[row] + offset
    name = prefix_names(whole, at)
    seed, doc, hash_, first = (pdf[c].to_numpy() for c in ("seed", "doc", "hash", "first"))
    start = first[row] + offset
    order = np.lexsort((start, hash_[row], doc[row], name))
    again = np.zeros(len(order), bool)
    again[order[1:]] = name[order][1:] == name[order][:-1]
    alone = np.flatnonzero(~again & (pdf["salts"].to_numpy()[row] > 1))
    # neighbouring repeats of a run are one range
    opens = np.flatnonzero(again & ~(np.append(False, again[:-1]) & (offset > 0)))
    closes = np.flatnonzero(again & ~(np.append(again[1:], False) & np.append(offset[1:] > 0, False)))
    digest = rolling(whole, LENGTH).view(np.int64) if len(alone) else name  # other tasks number their strings otherwise
    for low, high, is_open in ((opens, closes, False), (alone, alone, True)):
        for i in range(0, len(low), 1 << 17):
            pick, end = low[i:i + (1 << 17)], high[i:i + (1 << 17)]
            yield pd.DataFrame({
                "doc": doc[row[pick]], "hash": hash_[row[pick]], "first": start[pick].astype("int32"), "last": start[end].astype("int32"),
                "seed": seed[row[pick]], "name": digest[at[pick]] if is_open else 0, "open": is_open})


def _released() -> None:
    """Lets Spark drop shuffle files of finished steps; else they stay until the driver happens to collect its garbage."""
    from pyspark import SparkContext

    gc.collect()
    SparkContext._active_spark_context._jvm.System.gc()


def _step(df: DataFrame) -> DataFrame:
    written = durable(df)
    _released()
    return written


def different(docs: DataFrame) -> DataFrame:
    """One of each group of equal rows (doc, hash, text); only rows that have copies are shuffled."""
    copies = _step(docs.groupBy("doc", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "hash", F.lit(True).alias("copied")))
    n = copies.count()
    if not n:
        return docs
    marked = docs.join(checked_broadcast(copies, n), ["doc", "hash"], "left")
    single = marked.filter("copied is null").select("doc", "hash", "text")
    return single.unionAll(_step(marked.filter("copied").select("doc", "hash", "text").distinct()))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, hash, first, last): runs of starts whose strings also start earlier, from different rows (doc, hash, text)."""
    scan = docs.select("text").mapInArrow(_seeds, "seed long")
    shared = _step(scan.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"))
    hits = _step(docs.mapInArrow(_named_runs, _RUN).join(shared, "seed", "left_semi"))
    place = F.struct("doc", "hash", "first", "last")  # equal names have equal lengths
    names = _step(hits.groupBy("seed", "name").agg(F.min(place).alias("least"), F.count("*").alias("n")))
    ahead = names.filter("n > 1").select("seed", "name", "least")
    later = _step(hits.join(ahead, ["seed", "name"]).filter(place > F.col("least")).select("doc", "hash", "first", "last"))
    # candidates: the earliest run of each name, where a sampled string has several names
    several = names.groupBy("seed").agg(F.count("*").alias("k")).filter("k > 1").select("seed", F.ceil(F.col("k") / GROUP).cast("int").alias("salts"))
    runs_ = names.join(_step(several), "seed").select("least.*", "seed", "salts")
    runs_ = _step(runs_.groupBy("doc", "hash").agg(F.collect_list(F.struct("seed", "salts", "first", "last")).alias("runs")))
    strings = small_batches(docs.join(runs_, ["doc", "hash"]).select("doc", "hash", "text", "runs")).mapInArrow(_strings, _STRINGS)
    tasks = max(1, names.count() // TASK_RUNS)
    salt = F.pmod(F.xxhash64("doc", "hash", "first"), F.col("salts"))
    starts = _step(strings.repartition(tasks, F.col("seed"), salt).mapInPandas(_compared, _STARTS))
    found = later.unionAll(starts.filter("not open").select("doc", "hash", "first", "last"))
    alone = starts.filter("open").drop("open")
    if not alone.isEmpty():
        least = alone.groupBy("seed", "name").agg(F.min(place).alias("least"), F.count("*").alias("n"))
        least = _step(least.filter("n > 1").drop("n"))
        found = found.unionAll(alone.join(least, ["seed", "name"]).filter(place > F.col("least")).select("doc", "hash", "first", "last"))
    return found


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text, firsts, lasts in zip(part["doc_id"], part["text"], part["firsts"], part["lasts"], strict=True):
                data = (text or "").encode()
                edge = np.zeros(len(data) + 1, np.int32)
                if firsts is not None:
                    np.add.at(edge, np.asarray(firsts, np.int64), 1)
                    np.add.at(edge, np.asarray(lasts, np.int64) + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})
    return run


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, counts, the hash of the kept bytes and, if asked, those bytes."""
    rows = small_batches(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("hash"))
    found = repeats(different(rows.select("doc", "hash", "text")))
    ranges = found.groupBy("doc", "hash").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    ranges = _step(ranges.select("doc", "hash", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts")))
    out = rows.join(ranges, ["doc", "hash"], "left").select("doc_id", "text", "firsts", "lasts").mapInPandas(_cut(with_text), _CUT)
    return out if with_text else out.drop("kept")


@query("op4_substrings")
def _op4(table):
    return without_repeats(table("documents"), with_text=False)
