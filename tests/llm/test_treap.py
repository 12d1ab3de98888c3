"""The K2-treap and the joint descent against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import treap

WORD = re.compile(treap.TERMS)


def words(text):
    folded = (text or "").translate(str.maketrans(treap.UPPER, treap.LOWER))
    return WORD.findall(folded)


def brute(docs, items, places=20):
    """{(item_id, text): [(doc_id, score)]} by the formulas, document by document."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    count, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = {}
    for item_id, text in set(items):
        scored = []
        for doc_id, bag, n in bags:
            m = 100 - 25 + 25 * n * count // total
            score = 0
            for t in words(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out[item_id, text] = [(None if none else d, -s) for s, none, d in sorted(scored)[:places]]
    return out


def found(spark, docs, items, **clashing):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clashing or {"n": F.lit(1)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns(clashing or {"n": F.lit(1)})
    got = treap.search(treap.build_index(d), i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    out = {}
    for r in got.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def corpus(rng, n, vocabulary=60):
    pool = [f"w{i}" for i in range(vocabulary)]
    weights = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(rng.choice(pool, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(n)]


@pytest.mark.parametrize("wave", [1, 64])
@pytest.mark.parametrize("block", [7, 8192])
def test_same_as_scoring_everything(spark, monkeypatch, wave, block):
    monkeypatch.setattr(treap, "WAVE", wave)
    monkeypatch.setattr(treap, "BLOCK_DOCS", block)
    monkeypatch.setattr(treap, "SLICE", 4)
    rng = np.random.default_rng(block + wave)
    docs = list(enumerate(corpus(rng, 300)))
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # copies tie
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))] + [(50, docs[5][1])]
    expected = {k[0]: v for k, v in brute(docs, items).items() if v}
    assert found(spark, docs, items) == expected


def test_odd_rows(spark):
    docs = [(3, "Äpfel BIRNEN x1"), (3, "Äpfel BIRNEN x1"), (None, "birnen_birnen"), (None, "äpfel"), (4, None), (5, ""), (6, "--- !!"),
            (7, "Äpfel\x7fbirnen"), (8, "long " * 300_000 + "birnen"), (9, "b\x00x1")]
    items = [(1, "birnen Äpfel, birnen?"), (1, "birnen Äpfel, birnen?"), (2, None), (3, ""), (4, "unknown"), (5, "X1")]
    expected = {k[0]: v for k, v in brute(docs, items).items() if v}
    got = found(spark, docs, items, no=F.lit(1), slice=F.lit(2), terms=F.lit(3), rank=F.lit(4))
    assert got == expected and set(got) == {1, 5}


def test_grid_holds_every_cell():
    rng = np.random.default_rng(2)
    rows, cols = rng.integers(0, 40, 300), rng.integers(0, 90, 300)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rows, cols, rng.integers(1, 10**6, 300), strict=True)}
    r, c = np.array(list(cells)).T
    grid = treap.Grid.build(r, c, np.array(list(cells.values())), 90)
    grid = treap.Grid.unpacked(grid.height, *grid.packed())
    first = grid.children()
    for (row, col), value in cells.items():
        node = 0
        for level in range(grid.height):
            below = grid.height - 1 - level
            assert grid.maxima[node] >= value
            quadrant = (row >> below & 1) * 2 + (col >> below & 1)
            assert grid.bits[node] >> quadrant & 1
            node = first[node] + bin(grid.bits[node] & ((1 << quadrant) - 1)).count("1")
        assert grid.maxima[node] == value
    assert grid.maxima[0] == max(cells.values()) and len(grid.maxima) == 1 + sum(bin(b).count("1") for b in grid.bits)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert found(spark, docs, items) == {} or found(spark, docs, items) == {1: brute(docs, items)[1, "a"]}
    none_docs = spark.createDataFrame([], "doc_id long, text string")
    none_items = spark.createDataFrame([], "item_id long, text string")
    assert treap.search(treap.build_index(none_docs), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert treap.search(treap.build_index(spark.createDataFrame(docs, "doc_id long, text string")), none_items).collect() == []
