"""SimHash near duplicates by multi-index hashing.

A fingerprint has a bit for each bit that is set in over half of the XXH64 hashes of a text's word shingles. Equal
fingerprints become one node. The 64 bits are cut into segments; two fingerprints within `distance` bits agree in some
segment up to distance // segments bits, so each node's segments stand in a table and the small Hamming balls around
its segments are looked up there, and the complete distance decides (`ball_radii` gives the radii that suffice).

Defined results: null, empty and blank texts have fingerprint zero, which is linked like any other. A component's name
is its smallest doc_id; rows without doc_id are linked but name nothing. Repeated rows give a row each. An empty table
gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import durable, query, small_batches
from tallyloom.llm.graph import components

SHINGLE = 4
DISTANCE = 4
#: Numbers of segments to choose from; each finds the same links.
SEGMENTS = (3, 2)
_CHUNK = 1 << 16


def text_fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest, seed, ones, n, part = xxhash.xxh64_intdigest, 42, np.zeros(64, np.int64), 0, []
    for part in _parts([digest(s, seed) for s in shingles]):
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def _parts(hashes: list[int]) -> Iterator[list[int]]:
    for i in range(0, len(hashes), _CHUNK):
        yield hashes[i:i + _CHUNK]


@F.pandas_udf(T.LongType())
def fingerprint(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([text_fingerprint(t) for t in part], dtype="int64")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    ends = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def ball_radii(distance: int, segments: int) -> list[int]:
    """Radii that find every pair: were all segments further apart than these, the sum would exceed the distance."""
    most, rest = divmod(distance, segments)
    return [most if i <= rest else most - 1 for i in range(segments)]


def ball(bits: int, radius: int) -> list[int]:
    """Masks of up to `radius` set bits."""
    found = {0}
    for _ in range(max(0, radius)):
        found |= {m ^ (1 << b) for m in found for b in range(bits)}
    return sorted(found) if radius >= 0 else []


def best_segments(nodes: int, distance: int = DISTANCE) -> int:
    """The number of segments with the least work: values looked up, and table matches to verify, for evenly spread fingerprints.

    Longer segments take larger balls but match fewer of the nodes, so they pay from some 25 million nodes on."""
    def work(segments: int) -> float:
        balls = [sum(math.comb(bits, k) for k in range(r + 1)) for (_, bits), r in zip(segment_bounds(segments), ball_radii(distance, segments), strict=True)]
        return sum(b + b * nodes / 2**bits for b, (_, bits) in zip(balls, segment_bounds(segments), strict=True))
    return min(SEGMENTS, key=work)


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of different `fingerprint`s of `nodes` within `distance` bits."""
    segments = segments or best_segments(nodes.count(), distance)
    fp, bounds, radii = F.col("fingerprint"), segment_bounds(segments), ball_radii(distance, segments)
    entries = [F.struct(F.lit(k).alias("segment"), _part(fp, *at).alias("value")) for k, at in enumerate(bounds)]
    table = nodes.select(fp.alias("b"), F.explode(F.array(*[e for e, r in zip(entries, radii, strict=False) if r >= 0])).alias("e"))
    looked = []
    for k, (first, bits) in enumerate(bounds):
        masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radii[k])])
        if radii[k] >= 0:
            looked.append(nodes.select(fp.alias("a"), F.lit(k).alias("segment"), F.explode(masks).alias("mask")).select(
                "a", "segment", _part(F.col("a"), first, bits).bitwiseXOR(F.col("mask")).alias("value")))
    probes = looked[0]
    for more in looked[1:]:
        probes = probes.unionAll(more)
    table = table.select("b", "e.segment", "e.value")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    same = (probes["segment"] == table["segment"]) & (probes["value"] == table["value"])
    return probes.join(table, same & near).select("a", "b").distinct()


def grouped(rows: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """(fingerprint, component_id, keep): for each fingerprint of `rows` (doc_id, fingerprint, rid) the smallest doc_id that is
    reachable and the `rid` of the one row of the component that stays."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = durable(rows.groupBy("fingerprint").agg(F.min(rank).alias("least")))
    roots = components(links(nodes.select("fingerprint"), distance, segments))
    placed = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    placed = durable(placed.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"))
    best = placed.groupBy("root").agg(F.min("least").alias("best"))
    return placed.join(best.repartition(_shuffles(rows)), "root").select(
        "fingerprint", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keep"))


def _shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components_of(docs: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    rows = small_batches(docs.select("doc_id", "text")).select(
        "doc_id", fingerprint("text").alias("fingerprint"), F.monotonically_increasing_id().alias("rid"))
    rows = durable(rows)
    found = durable(grouped(rows, distance, segments).drop("keep"))
    return rows.drop("rid").join(found, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """The rows of `docs` without all but one of each component; their columns as they are."""
    marked = small_batches(docs).select(F.struct("*").alias("row"), F.col("text").alias("t"), F.monotonically_increasing_id().alias("rid"))
    marked = durable(marked.select("row", "rid", fingerprint("t").alias("fingerprint")))
    rows = marked.select(F.col("row.doc_id").alias("doc_id"), "fingerprint", "rid")
    found = grouped(rows, distance, segments)
    going = durable(rows.join(found, "fingerprint").filter("rid <> keep").select("rid"))
    return marked.join(going, "rid", "left_anti").select("row.*")


@query("op3_simhash")
def _op3(table):
    return components_of(table("documents"))
