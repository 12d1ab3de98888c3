"""Runs of words against brute force, by tiles of any size and through Spark."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import periodic
from tallyloom.llm.common import QUERIES


def brute(words):
    """(start, length, period) of all runs by comparing every pair of places."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, length, q) for (s, length), q in out.items())


def by_tiles(ids):
    n, parts = len(ids), {}
    for low, high, first, last, base, end in periodic.tiles(n):
        for q, lo, hi in zip(*(x.tolist() for x in periodic.fragments(ids[base:end], low, high, first - base, last - base)), strict=True):
            parts.setdefault(q, []).append([lo + base, hi + base])
    out = {}
    for q, spans in sorted(parts.items()):
        joined = []
        for lo, hi in sorted(spans):
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], hi)
            else:
                joined.append([lo, hi])
        for lo, hi in joined:
            if hi - lo + q >= max(6, 4 * q):
                out.setdefault((lo, hi - lo + q), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def periodic_words(rng, n):
    words = rng.integers(0, rng.integers(2, 5), n)
    for _ in range(rng.integers(0, 3)):
        p, a = int(rng.integers(1, max(2, n // 3))), int(rng.integers(0, n))
        for i in range(a + p, int(rng.integers(a, n + 1))):
            words[i] = words[i - p]
    return words.astype(np.int32)


@pytest.mark.parametrize("tile", [32, 64, 1 << 14])
@pytest.mark.parametrize("in_step", [4, 64])
def test_tiles_give_all_runs(monkeypatch, tile, in_step):
    for name, value in (("TILE", tile), ("SMALL", max(1, tile // 16)), ("IN_STEP", in_step), ("SCREEN", min(16, in_step))):
        monkeypatch.setattr(periodic, name, value)
    rng = np.random.default_rng(tile + in_step)
    for _ in range(200):
        words = periodic_words(rng, int(rng.integers(4, 300)))
        assert by_tiles(words) == brute(words.tolist()), words.tolist()


def test_z_function():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(0, 2, rng.integers(0, 40))
        z = periodic.z_function(s)
        for i in range(len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = None
    for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_brute_force(spark, tmp_path, rows):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}é" for x in periodic_words(rng, int(rng.integers(1, 200)))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [
        (400, None), (401, ""), (402, " \t\n "), (None, "a a a a a a a"), (None, None), (7, texts[8]), (7, texts[8]),
        (403, "x y x y\x0bx y x y x y\rx y"), (404, "one"), (405, "to be " * 40 + "or " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "period": F.lit(2), "ids": F.lit(3)})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_runs"](spark, str(tmp_path))
    assert found.columns == list(COLUMNS)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert rows(found) == sorted((expected(*d) for d in docs), key=key)


def test_long_documents_are_tiled(spark, monkeypatch):
    """Texts beyond one tile go through tile rows of other tasks; runs cross the borders of tiles."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 5000, 40_000)
    one[3_000:21_000] = np.resize(one[3_000:4_500], 18_000)
    one[30_000:39_000] = 7
    two = np.resize(rng.integers(0, 10**6, 7_000), 33_000)
    docs = [(1, " ".join(map(str, one))), (2, " ".join(map(str, two))), (3, "a b " * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows_, runs = periodic.scan(frame)
    got = sorted((r.doc_id, r.start, r.length, r.period) for r in runs.join(rows_, "row").collect())
    assert (1, 30_000, 9_000, 1) in got and (3, 0, 40, 2) in got and (2, 0, 33_000, 7_000) in got
    assert any(d == 1 and q == 1500 and s <= 3_000 and s + n >= 21_000 for d, s, n, q in got) and len(got) == 4
    texts = {r.doc_id: r.collapsed for r in periodic.collapsed(frame).collect()}
    assert texts[3] == "a b" and texts[2] == " ".join(map(str, two[:7_000]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.collapsed(empty).collect() == []
