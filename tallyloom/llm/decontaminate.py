"""Benchmark decontamination: a prefix-filtered join of item windows with document shingles.

A window is a run of `WINDOW` consecutive item words (a shorter item is one window). A window that occurs must occur with
all its shingles, so the prefix of its shingles, ordered by rarity in the corpus, is the rarest one alone. A first pass
counts the benchmark's shingles in all documents; the second looks each document's shingles up among the prefixes,
places the window by the shingle's position in it, drops places that start before the document or end after it, and
compares all words. The benchmark is the stated query set: it goes to the tasks in blocks of bounded size, one after the
other, whatever its total size.

Defined results: null texts and items have no words and no hits. An item is an item_id; repeated items count once, items
without id go by an empty name. Repeated documents give a row each. Empty tables give empty results or no hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import durable, query, small_batches

WINDOW = 10
SHINGLE = 3
#: Characters of benchmark text in a block; an item stands in one block as a whole.
BLOCK_CHARS = 4_000_000
_LETTERS = {*range(0x30, 0x3A), *range(0x61, 0x7B)}
_TABLE = bytes((c + 32) if 0x41 <= c <= 0x5A else c if c >= 0x80 or c in _LETTERS else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Windows:
    """The windows of a block of items, by width, with word numbers; shingles by rarity."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [number.setdefault(w, len(number)) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + WINDOW]), set()).add(name)
        self.base = len(number) + 1
        if self.base ** SHINGLE >= 1 << 63:
            raise ValueError(f"a block has {self.base} words; make BLOCK_CHARS smaller")
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.prefixes: dict[int, tuple[np.ndarray, ...]] = {}

    @classmethod
    def of(cls, state: dict) -> Windows:
        """From plain data, as tasks get it."""
        made = object.__new__(cls)
        made.__dict__ = state
        return made

    def key(self, ids) -> int:
        k = 0
        for i in ids:
            k = k * self.base + int(i)
        return k

    def shingles(self, window: tuple[int, ...]) -> list[int]:
        n = min(SHINGLE, len(window))
        return [self.key(window[i:i + n]) for i in range(len(window) - n + 1)]

    def all_keys(self) -> dict[int, np.ndarray]:
        """By shingle width the sorted keys of all shingles."""
        found: dict[int, set[int]] = {}
        for w in self.windows:
            found.setdefault(min(SHINGLE, len(w)), set()).update(self.shingles(w))
        return {n: np.array(sorted(x), np.int64) for n, x in found.items()}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Picks each window's rarest shingle: by shingle width, sorted keys, then (offset, window) pairs grouped by key."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for at, w in enumerate(self.windows):
            n = min(SHINGLE, len(w))
            _, offset, key = min((counts.get((n, k), 0), o, k) for o, k in enumerate(self.shingles(w)))
            if counts.get((n, key), 0):
                rows.setdefault(n, []).append((key, offset, at))
        for n, found in rows.items():
            found.sort()
            key, offset, at = (np.array(x, np.int64) for x in zip(*found, strict=True))
            keys, first = np.unique(key, return_index=True)
            self.prefixes[n] = (keys, np.append(first, len(key)), offset, at)
        self.width = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.full((len(self.windows), WINDOW), -1, np.int64)
        for i, w in enumerate(self.windows):
            self.words[i, :len(w)] = w

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)

    def keys_of(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the shingles of n words that the vocabulary knows."""
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        full = known[:len(ids) - n + 1].copy()
        for i in range(1, n):
            full &= known[i:len(ids) - n + 1 + i]
        at = np.flatnonzero(full)
        key = np.zeros(len(at), np.int64)
        for i in range(n):
            key = key * self.base + ids[at + i]
        return at, key

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of all occurrences."""
        starts, which = [], []
        for n, (keys, first, offset, window) in self.prefixes.items():
            at, key = self.keys_of(ids, n)
            place = np.searchsorted(keys, key)
            same = keys[np.minimum(place, len(keys) - 1)] == key
            at, place = at[same], place[same]
            reach = first[place + 1] - first[place]
            pick = np.repeat(first[place], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            start, w = np.repeat(at, reach) - offset[pick], window[pick]
            fits = (start >= 0) & (start + self.width[w] <= len(ids))
            start, w = start[fits], w[fits]
            for i in range(WINDOW):
                inside = i < self.width[w]
                good = ~inside | (ids[np.minimum(start + i, len(ids) - 1)] == self.words[w, i])
                start, w = start[good], w[good]
            starts.append(start)
            which.append(w)
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64),) * 2


def _blocks(benchmark: DataFrame) -> Iterator[Windows]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").filter("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    for i in range(n):  # each block is bounded, one is on the driver at a time
        found = rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i).collect()
        if found:
            yield Windows([(r.name, r.text) for r in found])


def _counted(docs: DataFrame, block: Windows) -> dict[tuple[int, int], int]:
    """How often the block's shingles stand in the corpus; as many numbers as the block has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((vars(block), block.all_keys()))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, keys = shared.value
        windows = Windows.of(state)
        total = {n: np.zeros(len(k), np.int64) for n, k in keys.items()}
        for part in parts:
            for text in part["text"]:
                ids = windows.numbers(words_of(text))
                for n, known in keys.items():
                    _, key = windows.keys_of(ids, n)
                    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    np.add.at(total[n], place[known[place] == key], 1)
        for n, x in total.items():
            some = np.flatnonzero(x)
            yield pd.DataFrame({"width": n, "key": keys[n][some], "n": x[some]}).astype("int64")

    rows = docs.select("text").mapInPandas(count, "width long, key long, n long").groupBy("width", "key").agg(F.sum("n").alias("n"))
    return {(r["width"], r["key"]): r["n"] for r in rows.collect()}


_STATE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("bits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _matcher(spark, block: Windows | None):
    shared = spark.sparkContext.broadcast(vars(block) if block else None)

    def one(text: str | None, bits: bytes | None, items) -> dict:
        words = words_of(text)
        hit = np.zeros(len(words), bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
        names = set(items) if items is not None else set()
        if shared.value and words:
            windows = Windows.of(shared.value)
            start, which = windows.hits(windows.numbers(words))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + windows.width[which], -1)
            hit |= np.cumsum(edge[:-1]) > 0
            for w in np.unique(which):
                names.update(windows.owners[w])
        n_hit = int(hit.sum())
        return {"n_words": len(words), "n_hit": n_hit, "bits": np.packbits(hit).tobytes() if n_hit else None, "items": sorted(names)}

    @F.pandas_udf(_STATE)
    def first(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            yield pd.DataFrame([one(t, None, None) for t in text], columns=_STATE.names)

    @F.pandas_udf(_STATE)
    def further(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for text, old in parts:
            yield pd.DataFrame([one(t, b, i) for t, b, i in zip(text, old["bits"], old["items"], strict=True)], columns=_STATE.names)

    return first, further


def with_hits(docs: DataFrame, benchmark: DataFrame, into: str) -> DataFrame:
    """Adds a struct (n_words, n_hit, bits: a bit per word, items) to rows that have a `text`."""
    docs, state = small_batches(docs), None
    for block in _blocks(benchmark):
        block.order(_counted(docs, block))
        first, further = _matcher(docs.sparkSession, block)
        docs = docs.withColumn(into, further("text", into) if state else first("text"))
        state = True
    return docs if state else docs.withColumn(into, _matcher(docs.sparkSession, None)[0]("text"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without any benchmark window, with their columns as they are."""
    wide = docs.select(F.struct("*").alias("row"), "text")
    return with_hits(wide, benchmark, "state").filter("state.n_hit = 0").select("row.*")


@query("op6_decontaminate")
def _op6(table):
    docs = table("documents").select("doc_id", "text")
    out = durable(with_hits(docs, table("benchmark"), "state").select("doc_id", "state"))
    return out.select(
        "doc_id", "state.n_words", "state.n_hit", F.size("state.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("state.items")), 256).alias("items_sha256"), (F.col("state.n_hit") > 0).alias("contaminated"))
