"""Ranked lexical search: K2-treaps over the term-document grid, descended jointly by the terms of an item.

Documents are cut into blocks. A block's grid has a row per term (frequent terms first) and a column per document (in the
order of ids); a cell holds the impact of the term in the document. The grid is a quadtree: a node stores which of its
four quadrants are not empty and the largest impact in it, levels one after the other, so that children are found by
counting bits. Every document of the table is in a block, with all its terms.

A search goes down a block's tree with all terms of an item at once. A document range of a level has, for each term, the
node that covers the term's row and the range; the sum of weight times largest impact bounds every score in the range.
The ranges of an item with the greatest bounds are opened first, in waves over all items of a slice. A range is left out
only if its bound is below the score of the item's last place so far, or equal to it where all its ids come later; at
single documents the bound is the score. A task carries its best places on from block to block, and the best
of all tasks are ranked by Spark. Nothing is approximate: results equal those of scoring every document.

Impact: (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, where the document has n terms and the N documents
that have terms have L. Weight: floor(1000 ln((2 N + 2) / (2 df + 1))). Integers have 64 bits.

Defined results: null and empty texts have no terms; such documents are never found and such items find nothing. Equal
scores go by ascending id, null ids last. Every row of documents is ranked, so rows that repeat an id can take several
places. Items are the distinct rows (item_id, text); two items that share an id are ranked apart. Texts of any length are
read whole. Empty tables give empty results, extra columns are left out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import durable, query, small_batches

#: A block closes at so many documents or terms with repeats.
BLOCK_DOCS = 4096
BLOCK_TERMS = 1_000_000
#: Items searched together; a slice of items is one row.
SLICE = 500
#: Slices are broadcast only up to so many (item, term) pairs, which are counted.
BROADCAST_PAIRS = 1_000_000
#: Ranges of an item that one wave opens.
WAVE = 256
PLACES = 20

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 text: A-Z become a-z, ASCII that is neither letter nor digit becomes a blank.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_POPCOUNT = np.array([bin(b).count("1") for b in range(16)], np.int64)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@F.pandas_udf(T.LongType())
def term_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(terms_of(t)) for t in texts], dtype="int64")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Integer impacts of terms that occur `tf` times in documents of `n` terms."""
    m = 75 + 25 * n * docs // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _interleaved(rows: np.ndarray, cols: np.ndarray, height: int) -> np.ndarray:
    code = np.zeros(len(rows), np.int64)
    for bit in range(height):
        code |= ((rows >> bit & 1) << (2 * bit + 1)) | ((cols >> bit & 1) << (2 * bit))
    return code


@dataclass
class Grid:
    """A K2-treap: bits of non-empty quadrants of the inner nodes and largest impacts of all nodes, level by level."""
    height: int
    bits: np.ndarray
    maxima: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, side: int) -> Grid:
        height = max(1, (side - 1).bit_length())
        code = _interleaved(rows.astype(np.int64), cols.astype(np.int64), height)
        order = np.argsort(code)
        code, top = code[order], values[order].astype(np.int64)
        bits, maxima = [], [top]
        for _ in range(height):
            parent = code >> 2
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            bits.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), starts))
            top = np.maximum.reduceat(top, starts)
            maxima.append(top)
            code = parent[starts]
        return cls(height, np.concatenate(bits[::-1]), np.concatenate(maxima[::-1]))

    def children(self) -> np.ndarray:
        """Place of each inner node's first child."""
        counts = _POPCOUNT[self.bits]
        return 1 + np.cumsum(counts) - counts

    def packed(self) -> tuple[bytes, bytes]:
        """Compressed bits and what each maximum lacks to its parent's; one child of a node lacks nothing."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        lacks = np.append(self.maxima[:1], np.repeat(self.maxima[:len(self.bits)], _POPCOUNT[self.bits]) - self.maxima[1:])
        return squeeze(self.bits.tobytes()), squeeze(lacks.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())

    @classmethod
    def unpacked(cls, height: int, bits: bytes, maxima: bytes) -> Grid:
        expand = zstandard.ZstdDecompressor().decompress
        bits = np.frombuffer(expand(bits), np.uint8)
        lacks = np.frombuffer(expand(maxima), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        top, counts = [lacks[:1]], _POPCOUNT[bits]
        inner, at = 0, 1
        for _ in range(height):
            nodes = counts[inner:inner + len(top[-1])]
            inner += len(top[-1])
            below = np.repeat(top[-1], nodes)
            top.append(below - lacks[at:at + len(below)])
            at += len(below)
        return cls(height, bits, np.concatenate(top))


_INDEX = "height int, bits binary, maxima binary, ids binary, unnamed long, terms array<string>, dfs array<int>"


class Block:
    """Documents of one grid while they come in: numbers of their terms and how often they occur."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        bag = Counter(found)
        self.ids.append(doc_id)
        self.terms.append(np.array([self.known.setdefault(t, len(self.known)) for t in bag], np.int32))
        self.tfs.append(np.fromiter(bag.values(), np.int32, len(bag)))
        self.sizes.append(len(found))
        self.held += len(found)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.held >= BLOCK_TERMS

    def row(self, docs: int, total: int) -> pd.DataFrame:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        col = np.repeat(np.arange(len(order)), [len(self.terms[i]) for i in order])
        term, tf = (np.concatenate([x[i] for i in order]) for x in (self.terms, self.tfs))
        size = np.array(self.sizes, np.int64)[order][col]
        dfs = np.bincount(term, minlength=len(self.known))
        by_df = np.argsort(-dfs, kind="stable")
        row = np.empty_like(by_df)
        row[by_df] = np.arange(len(by_df))
        grid = Grid.build(row[term], col, impacts(tf.astype(np.int64), size, docs, total), max(len(dfs), len(order)))
        bits, maxima = grid.packed()
        names = [t.decode() for t in self.known]
        numbered = np.array([self.ids[i] or 0 for i in order], np.int64)
        return pd.DataFrame({
            "height": [grid.height], "bits": [bits], "maxima": [maxima], "ids": [numbered.tobytes()],
            "unnamed": [sum(i is None for i in self.ids)], "terms": [[names[i] for i in by_df]], "dfs": [dfs[by_df].astype(np.int32)]})


def _builder(docs: int, total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if found := terms_of(text):
                    block.add(None if pd.isna(doc_id) else int(doc_id), found)
                if block.full():
                    yield block.row(docs, total)
                    block = Block()
        if block.ids:
            yield block.row(docs, total)
    return run


@dataclass
class Index:
    """Blocks of the grid as a table, with the numbers of documents that have terms and of their terms."""
    blocks: DataFrame
    docs: int
    terms: int


def build_index(docs: DataFrame) -> Index:
    """Indexes every row of `docs` (doc_id, text)."""
    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counted = rows.select(term_count("text").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    made = durable(rows.mapInPandas(_builder(counted.docs, counted.terms or 1), _INDEX))
    return Index(made, counted.docs, counted.terms or 0)


def weighted_items(index: Index, items: DataFrame) -> DataFrame:
    """(no, term, weight): weights of an item's terms times their repeats; terms of no document are left out."""
    folded = F.translate("text", UPPER, LOWER)
    pairs = items.select("no", F.explode(F.regexp_extract_all(folded, F.lit(TERMS), F.lit(0))).alias("term")).groupBy("no", "term").agg(F.count("*").alias("times"))
    wanted = pairs.select("term").distinct()
    listed = index.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    dfs = listed.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2.0 * F.col("df") + 1)))
    return pairs.join(dfs, "term").select("no", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")


class Best:
    """The best places of numbered items so far: (item, score, id), null ids after all others."""

    def __init__(self, items: int, places: int):
        self.places = places
        self.item, self.score, self.unnamed, self.id = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.ones(items, np.int64)  # scores below it are not wanted
        self.last_unnamed, self.last_id = np.ones(items, np.int64), np.full(items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        unnamed, ids = np.concatenate([self.unnamed, unnamed]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, unnamed, -score, item))
        place = _places(item[order])
        order = order[place < self.places]
        self.item, self.score, self.unnamed, self.id = item[order], score[order], unnamed[order], ids[order]
        full = np.flatnonzero(_places(self.item) == self.places - 1)
        of = self.item[full]
        self.least[of], self.last_unnamed[of], self.last_id[of] = self.score[full], self.unnamed[full], self.id[full]

    def wants(self, item: np.ndarray, bound: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Could a document with this bound and at best this id still take a place?"""
        earlier = (unnamed < self.last_unnamed[item]) | ((unnamed == self.last_unnamed[item]) & (ids <= self.last_id[item]))
        return (bound > self.least[item]) | ((bound == self.least[item]) & earlier)


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal values."""
    n = len(groups)
    begins = np.concatenate([[True], groups[1:] != groups[:-1]]) if n else np.zeros(0, bool)
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(begins, at, 0)) if n else at


class Pool:
    """Growing columns (node, slot) for the terms of open ranges; what closed ranges held is dropped now and then."""

    def __init__(self):
        self.node, self.slot, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def add(self, node: np.ndarray, slot: np.ndarray) -> int:
        """Place of the first new row."""
        at, end = self.used, self.used + len(node)
        if end > len(self.node):
            self.node, self.slot = (np.concatenate([x[:at], np.zeros(max(end, 2 * at) - at, x.dtype)]) for x in (self.node, self.slot))
        self.node[at:end], self.slot[at:end], self.used = node, slot, end
        return at

    def rows(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the range, place) of all rows of the given ranges."""
        owner = np.repeat(np.arange(len(start)), size)
        return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)

    def compact(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New starts of the ranges that stay, once they hold less than half of the rows."""
        if 2 * size.sum() >= self.used:
            return start
        _, at = self.rows(start, size)
        self.node[:len(at)], self.slot[:len(at)], self.used = self.node[at], self.slot[at], len(at)
        return np.cumsum(size) - size


def descend(grid: Grid, ids: np.ndarray, unnamed: int, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Best-first search of a block for (item, row, weight) triples ordered by item; `best` takes what it finds."""
    if not len(item):
        return
    first_child, height, width = grid.children(), grid.height, len(ids)
    named, pool = width - unnamed, Pool()
    begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    pool.add(np.zeros(len(item), np.int64), np.arange(len(item)))
    none = np.zeros(len(begins), np.int64)
    # open ranges: item, level, number in the level, bound, first row in the pool, rows
    open_ = [item[begins], none, none, np.add.reduceat(weight * int(grid.maxima[0]), begins), begins, np.diff(np.append(begins, len(item)))]
    while len(open_[0]):
        of, level, number, bound, _, _ = open_
        start = np.minimum(number << (height - level), width - 1)
        wanted = np.flatnonzero(best.wants(of, bound, start >= named, ids[start]))
        order = wanted[np.lexsort((start[wanted], -bound[wanted], of[wanted]))]
        opened = _places(of[order]) < WAVE
        closed = [x[order[~opened]] for x in open_]
        of, level, number, _, first, size = (x[order[opened]] for x in open_)
        owner, at = pool.rows(first, size)
        node, slot = pool.node[at], pool.slot[at]
        below = height - 1 - level[owner]
        bits = grid.bits[node]
        half = ((row[slot] >> below) & 1) * 2
        grown = [closed]
        for side in (0, 1):
            there = np.flatnonzero(bits >> (half + side) & 1)
            if not len(there):
                continue
            child = first_child[node[there]] + _POPCOUNT[bits[there] & ((1 << (half[there] + side)) - 1)]
            ranges = owner[there]
            starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
            parent = ranges[starts]
            bounds = np.add.reduceat(weight[slot[there]] * grid.maxima[child], starts)
            made = [of[parent], level[parent] + 1, number[parent] * 2 + side, bounds]
            leaf = made[1] == height
            if leaf.any():
                doc = made[2][leaf]
                best.add(made[0][leaf], bounds[leaf], doc >= named, ids[doc])
            begin = np.minimum(made[2] << (height - made[1]), width - 1)
            inner = ~leaf & best.wants(made[0], bounds, begin >= named, ids[begin])
            count = np.diff(np.append(starts, len(there)))
            spread = np.repeat(inner, count)
            base = pool.add(child[spread], slot[there][spread])
            count = count[inner]
            grown.append([*(x[inner] for x in made), base + np.cumsum(count) - count, count])
        open_ = [np.concatenate(x) for x in zip(*grown, strict=True)]
        open_[4] = pool.compact(open_[4], open_[5])


def _search(places: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[int, tuple[Best, np.ndarray, list[str], np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b in batch.itertuples():  # one block
                if b.slice not in slices:
                    no = np.array(b.nos, np.int64)
                    numbers, item = np.unique(no, return_inverse=True)
                    order = np.argsort(item, kind="stable")
                    slices[b.slice] = (Best(len(numbers), places), numbers, [b.words[i] for i in order], item[order], np.array(b.weights, np.int64)[order])
                best, _, words, item, weight = slices[b.slice]
                rows_of = {t: i for i, t in enumerate(b.terms)}
                row = np.array([rows_of.get(w, -1) for w in words], np.int64)
                has = row >= 0
                descend(Grid.unpacked(b.height, b.bits, b.maxima), np.frombuffer(b.ids, np.int64), b.unnamed, item[has], row[has], weight[has], best)
        for best, numbers, *_ in slices.values():
            yield pd.DataFrame({"no": numbers[best.item], "score": best.score,
                                "doc_id": pd.Series(best.id, dtype="Int64").mask(best.unnamed.astype(bool))})
    return run


def search(index: Index, items: DataFrame, places: int = PLACES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item of `items` (item_id, text)."""
    numbered = durable(items.select("item_id", "text").distinct().withColumn("no", F.monotonically_increasing_id()))
    weights = durable(weighted_items(index, numbered))
    pairs = weights.count()
    slices = max(1, -(-numbered.count() // SLICE))
    sliced = weights.groupBy(F.pmod(F.xxhash64("no"), F.lit(slices)).cast("int").alias("slice")).agg(
        F.collect_list(F.struct("no", "term", "weight")).alias("l")).select(
        "slice", F.col("l.no").alias("nos"), F.col("l.term").alias("words"), F.col("l.weight").alias("weights"))
    blocks = index.blocks.select("height", "bits", "maxima", "ids", "unnamed", "terms", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    joined = blocks.join(F.broadcast(sliced) if pairs <= BROADCAST_PAIRS else sliced, "slice")
    spark = joined.sparkSession
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "1")  # a block has megabytes
    try:
        found = durable(joined.mapInPandas(_search(places), "no long, score long, doc_id long"))
    finally:
        spark.conf.set(key, before)
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= places)
    return ranked.join(numbered.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")


_WORDS = (f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")


@query("op12_search", f"""
WITH words AS (SELECT doc_id, {_WORDS} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, t GROUP BY term),
q AS (SELECT item_id, {_WORDS} AS term FROM benchmark),
q2 AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
      FROM q2 JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), t GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
""")
def _op12(table):
    return search(build_index(table("documents")), table("benchmark"))
