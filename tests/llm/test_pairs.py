"""SimHash, byte repeats and fuzzy passages against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import chains, graph, simhash, substrings

DOCS = "doc_id long, text string"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("distance,segments", [(4, 3), (4, 4), (3, 5), (6, 2), (2, 3)])
def test_ball_radii_find_every_pair(distance, segments):
    radii, bounds, rng = simhash.ball_radii(distance, segments), simhash.segment_bounds(segments), random.Random(1)
    assert sum(n for _, n in bounds) == 64
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), distance))
        assert any((x >> a & (1 << n) - 1).bit_count() <= r for (a, n), r in zip(bounds, radii, strict=True))


def test_ball():
    assert simhash.ball(3, 1) == [0, 1, 2, 4] and simhash.ball(3, 0) == [0] and simhash.ball(3, -1) == []
    assert len(simhash.ball(21, 2)) == 1 + 21 + 210


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = roots({n for e in edges for n in e}, edges)
    assert found == {n: expected[n] for e in edges if e[0] != e[1] for n in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        words = [rng.choice(pool) for _ in range(rng.choice([3, 60, 400]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "Zz"
            rows.append((len(rows) * 7 % 97, " ".join(copy)))
    return rows + [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (None, "only nulls here"), (3, rows[3][1])]


def test_simhash(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"rid": F.lit(1), "component_id": F.lit("x")})
    prints = [fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    up = roots(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (a ^ b).bit_count() <= 4])
    least = {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            least[up[p]] = min(doc, least.get(up[p], doc))
    expected = sorted(((doc, f"{p:016x}", least.get(up[p])) for (doc, _), p in zip(rows, prints, strict=True)), key=str)
    assert sorted(map(tuple, simhash.components_of(docs).collect()), key=str) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(up.values()))
    assert {r.doc_id for r in kept.collect()} == {least.get(r) for r in up.values()}
    assert simhash.components_of(docs.limit(0)).count() == simhash.keep_one(docs.limit(0)).count() == 0


def test_every_number_of_segments_finds_the_same_links(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(63) for _ in range(60)}
    prints |= {p ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 7))) for p in sorted(prints)}
    nodes = spark.createDataFrame([(p,) for p in sorted(prints)], "fingerprint long")
    expected = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4}
    for segments in (None, *simhash.SEGMENTS):
        assert set(map(tuple, simhash.links(nodes, segments=segments).collect())) == expected
    assert simhash.best_segments(0) == simhash.best_segments(10**6) == 3 and simhash.best_segments(10**10) == 2


def cut(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(data[p:p + 100])
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[doc] = (len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group,part", [(2000, 1 << 20), (2, 300)])
def test_substrings(spark, monkeypatch, group, part):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "_PART", part)
    rng = random.Random(3)
    base = ["".join(rng.choice(["the ", "é", "of ", "running "]) for _ in range(70)) for _ in range(4)]
    rows = []
    for i in range(60):
        t, u = rng.choice(base), rng.choice(base)
        k = rng.randrange(len(t))
        rows.append((i, rng.choice([t, t[:k] + u[k:], "ab" * rng.randrange(150), t[:k] + "#" + t[k:], u * 2, "x" * rng.randrange(250)])))
    rows += [(100, None), (101, ""), (None, base[0]), (102, base[0] * 40)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"hash": F.lit(1), "first": F.lit("x")})
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(docs).collect()}
    assert found == cut(rows)
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_names_follow_the_order_of_prefixes():
    import numpy as np

    data = bytes(random.Random(1).choice(b"ab\xff") for _ in range(400)) * 3
    names = substrings.prefix_names(np.frombuffer(data, np.uint8), np.arange(len(data) - 99))
    strings = [data[i:i + 100] for i in range(len(data) - 99)]
    rank = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert names.tolist() == [rank[s] for s in strings]


def test_repeated_rows_are_one_document(spark):
    text = "".join(chr(97 + i % 23) + str(i) for i in range(100))
    rows = substrings.without_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, len(text))]


def test_repeated_rows_keep_their_text_if_another_shares_a_part(spark):
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    t, v = fresh(600), fresh(600)
    rows = [(None, v), (1, t), (2, fresh(90) + t[200:350] + fresh(90)), (3, fresh(90) + v[100:250] + fresh(90)), (4, fresh(300))]
    docs = spark.createDataFrame([*rows, (1, t), (None, v), (4, rows[4][1])], DOCS)
    found = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.without_repeats(docs).collect()]
    assert len(found) == 8 and dict(found) == cut(rows) and len(set(found)) == 5


def best_chain(a, b):
    best, score = 0, []
    for j in range(len(a)):
        s = chains.KMER
        for i in range(j):
            if a[i] < a[j] and b[i] < b[j]:
                s = max(s, score[i] + chains.KMER - chains.GAP_COST * (a[j] - a[i] + b[j] - b[i]))
        score.append(s)
        best = max(best, s)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_fenwick_chain_has_the_best_score(seed):
    import numpy as np

    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(40)})
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    found = chains.chained(a, b)
    assert all(a[i] < a[j] and b[i] < b[j] for c in found for i, j in zip(c, c[1:], strict=False))
    gain = lambda c: chains.KMER * len(c) - sum(chains.GAP_COST * (a[j] - a[i] + b[j] - b[i]) for i, j in zip(c, c[1:], strict=False))
    assert max([chains.KMER, *map(gain, found)]) == pytest.approx(best_chain(a.tolist(), b.tolist()))


def test_edits():
    import numpy as np

    assert chains.edits(np.array([1, 2, 3, 4]), np.array([1, 3, 4, 5])) == 2
    assert chains.edits(np.array([], int), np.array([1, 3])) == 2


def test_fuzzy_passages(spark):
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    passage = fresh(80)
    rows = [(i, " ".join(fresh(rng.randrange(40, 200)))) for i in range(60)]
    for i in range(60, 90):
        words = list(passage)
        for _ in range(i % 4):
            words[rng.randrange(80)] = rng.choice(pool)
        rows.append((i, " ".join(fresh(rng.randrange(60)) + words + fresh(rng.randrange(60)))))
    rows += [(90, rows[60][1]), (91, None), (92, ""), (None, "too short"), (90, rows[60][1]), (93, "tick " * 3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit(1), "least": F.lit("x")})
    found = chains.linked_documents(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].n_links == 0 for i in range(61))
    assert all(set(by[i].linked) <= set(range(60, i)) and by[i].n_passage_words >= 50 for i in range(61, 90))
    assert by[90].class_id == 60 and by[None].class_id is None and by[93].n_links == 0
    assert chains.linked_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2000, 2])
def test_passage_of_phrases_seen_before(spark, monkeypatch, hot):
    """B and C share a passage whose phrases stood singly in earlier documents, and near copies with few equal runs."""
    monkeypatch.setattr(chains, "HOT", hot)
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(5000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    rows, wanted = [], {}
    for case in range(20):
        at = case * 10
        phrases = [fresh(60 // (2 + case % 3)) for _ in range(2 + case % 3)]
        rows += [(at + i, " ".join(fresh(40) + p + fresh(40))) for i, p in enumerate(phrases)]
        rows += [(at + 8 + i, " ".join(fresh(40) + sum(phrases, []) + fresh(40))) for i in range(2)]
        wanted[at + 9] = at + 8
    for case in range(20):
        at, words = 1000 + case * 10, fresh(60)
        copy = [rng.choice(pool) if i % 8 == 7 else w for i, w in enumerate(words)]
        rows += [(at, " ".join(fresh(40) + words + fresh(40))), (at + 1, " ".join(fresh(40) + copy + fresh(40)))]
        wanted[at + 1] = at
    found = {r.doc_id: r for r in chains.linked_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: found[i].linked for i in wanted} == {i: [o] for i, o in wanted.items()}
    assert all(r.n_links == 0 for i, r in found.items() if i not in wanted)


@pytest.mark.parametrize("hot", [16, 2])
def test_passage_between_other_holders_of_its_phrases(spark, monkeypatch, hot):
    """Every seed of the passage of B and D stands first in A1 or A2 and last before D in C1 or C2; only B and D share the passage."""
    monkeypatch.setattr(chains, "HOT", hot)
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(5000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    rows, wanted = [], {}
    for at in range(0, 200, 10):
        passage = fresh(60)
        halves = passage[:33], passage[27:]
        spread = [fresh(40) + p + fresh(40) for p in (halves[0], halves[1], passage, halves[0], halves[1], passage)]
        rows += [(at + i, " ".join(words)) for i, words in enumerate(spread)]
        wanted[at + 5] = at + 2
    found = {r.doc_id: r for r in chains.linked_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.linked for i, r in found.items() if r.n_links} == {i: [o] for i, o in wanted.items()}
    assert all(r.component_id == wanted.get(i, i) for i, r in found.items())


def test_passage_at_a_later_place_of_a_repeated_phrase(spark):
    """A phrase stands twice in the earlier document, its second place in the passage; and two passages beside a gap too wide for one."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(5000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    phrase, (head, tail), (one, two) = fresh(8), (fresh(24), fresh(24)), (fresh(52), fresh(52))
    other = lambda words: [w if i % 5 else rng.choice(pool) for i, w in enumerate(words)]
    rows = [(1, fresh(30) + phrase + fresh(60) + head + phrase + tail + fresh(30)), (2, fresh(30) + other(head) + phrase + other(tail) + fresh(30)),
            (3, one + fresh(45) + two), (4, one + fresh(45) + two), (5, fresh(20) + ["tick"] * 70 + fresh(20)), (6, fresh(20) + ["tick"] * 300 + fresh(20))]
    found = {r.doc_id: r for r in chains.linked_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)).collect()}
    assert found[2].linked == [1] and found[2].n_passage_words >= 50
    assert found[6].linked == [5] and 300 <= found[6].n_passage_words <= 306
    assert found[4].linked == [3] and 104 <= found[4].n_passage_words <= 110


@pytest.mark.parametrize(("hot", "copies"), [(16, 256), (3, 8)])
def test_runs_through_a_common_passage(spark, monkeypatch, hot, copies):
    """Many documents share a passage; two of them share the text before it too, others have it with changed words."""
    monkeypatch.setattr(chains, "HOT", hot)
    monkeypatch.setattr(chains, "COPIES", copies)
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(5000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    common, body = fresh(120), fresh(150)
    rows = [(i, fresh(60) + common + fresh(60)) for i in range(30)]
    rows += [(i, fresh(60) + [rng.choice(pool) if k % 9 == i % 9 else w for k, w in enumerate(common)] + fresh(60)) for i in range(30, 40)]
    rows += [(i, fresh(20) + body + common + fresh(20)) for i in (50, 51)]
    found = {r.doc_id: r for r in chains.linked_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)).collect()}
    assert all(r.component_id == 0 for r in found.values()) and found[0].n_links == 0
    assert all(0 in found[i].linked and 120 <= found[i].n_passage_words <= 126 for i in range(1, 30))
    assert all(set(found[i].linked) >= set(range(30)) for i in range(30, 40))
    assert {0, 50} <= set(found[51].linked) and 270 <= found[51].n_passage_words <= 276


def test_all_holders_of_a_common_passage_are_linked(spark, monkeypatch):
    """More documents than COPIES share a passage; each is linked to all earlier ones, not to the first one alone."""
    monkeypatch.setattr(chains, "HOT", 3)
    monkeypatch.setattr(chains, "COPIES", 8)
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(5000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    common = fresh(70)
    rows = [(i, " ".join(fresh(20 + i) + common + fresh(60))) for i in range(20)]
    found = {r.doc_id: r for r in chains.linked_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: found[i].linked for i in range(20)} == {i: list(range(i)) for i in range(20)}
    assert all(found[i].n_links == i and 70 <= found[i].n_passage_words <= 76 for i in range(1, 20))


def test_signatures_miss_no_equal_words():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(200):
        x = rng.integers(0, 40, chains.SIDE).astype(np.uint32)
        y = x.copy()
        y[rng.choice(chains.SIDE, 10, replace=False)] = rng.integers(0, 40, 10)
        (a, b, n), (c, d, _) = (chains.signatures(w, np.array([0])) for w in (x, y))
        assert n[0] == chains.SIDE and sum(int(z).bit_count() for z in np.append(a & ~c, b & ~d).view(np.uint64)) <= 10


def _edited(rng, n, differing):
    """Two runs of words whose alignment has n columns, so many of them differing: words replaced, left out or put in; and whether KMER equal ones stand in a row."""
    kind = np.zeros(n, int)
    kind[rng.choice(n, differing, replace=False)] = rng.integers(1, 4, differing)
    fresh = lambda: int(rng.integers(1 << 40))
    a, b, run, longest = [], [], 0, 0
    for k in kind:
        word = fresh()
        run = run + 1 if k == 0 else 0
        longest = max(longest, run)
        a += [word] if k != 3 else []
        b += [] if k == 2 else [word if k in (0, 3) else fresh()]
    return a, b, longest >= chains.KMER


@pytest.mark.parametrize("hot", [16, 0])
def test_no_passage_fails_the_test_of_both_sides(spark, monkeypatch, hot):
    """Every passage with a seed has a match that passes, wherever its differences stand; few of all pairs that share a phrase of 18 words have one."""
    monkeypatch.setattr(chains, "HOT", hot)
    rng = np.random.default_rng(11)
    around = lambda n: rng.integers(1 << 40, size=n).tolist()
    rows, wanted = [], set()
    while len(rows) < 800:
        n = int(rng.integers(50, 70) if len(rows) % 4 else rng.integers(70, 120))
        a, b, some = _edited(rng, n, int(rng.integers(0, n // 5 + 1)))
        if some and len(a) >= chains.MIN_WORDS:
            k = len(rows)
            rows += [(k + i, [*around(int(rng.integers(0, 60))), *words, *around(int(rng.integers(0, 60)))]) for i, words in ((0, b), (1, a))]
            if min(len(w) for _, w in rows[-2:]) >= chains.MIN_WORDS:
                wanted.add((k + 1, k))
    phrase = around(18)
    rows += [(1000 + i, [*around(60), *phrase, *around(60)]) for i in range(30)]
    texts = spark.createDataFrame([(i, i, " ".join(map(str, w))) for i, w in rows], "id long, doc long, text string")
    near = {(r.id, r.oid) for r in chains._matches(texts).filter("near").collect()}
    assert len(wanted) > 300 and wanted <= near
    assert sum(i >= 1000 for i, _ in near) < 30 * 29 // 2 // 10


def test_places_of_a_periodic_stretch():
    import numpy as np

    words = np.append(np.arange(10, 20), [np.uint32(5)] * 200).astype(np.uint32)
    every = np.concatenate([at for _, at in chains.seeds(words)])
    seed, place, edge, inner = chains._places(words, every[every >= 10])
    assert sorted(place[edge]) == [9] and sorted(place[~edge & ~inner]) == [10, 204]
    assert sorted(place[inner]) == [54, 98, 142, 186]


def test_kinds_of_seeds():
    import numpy as np

    rng = np.random.default_rng(7)
    names = rng.integers(0, 60, 400).astype(np.uint64) ** np.uint64(2)
    names = np.append(names, np.repeat([np.uint64(1 << 39), np.uint64(5), np.uint64(7), np.uint64(11)], [1, 3, 9, 30]))
    sides = np.append(rng.integers(0, 2, 400), [8] * 43).astype(np.uint32)
    sides[5::3] = 9
    sides[-43:] = 8
    told = chains.kinds(names, sides, 6, 20)
    for name, kind in zip(names, told, strict=True):
        around = sides[names == name]
        n, alike = len(around), len(set(around)) == 1 and around[0] != 0
        level = [chains.LONE] * 2 if n == 1 else [chains.FEW, chains.FEW_ALIKE] if n <= 6 else [chains.MANY, chains.MANY_ALIKE] if n <= 20 else [chains.HOST, chains.HOST_ALIKE]
        assert kind == level[int(alike)]


def test_seeds_without_a_run_end_are_no_rows(spark):
    """Lone seeds and those between the same two words everywhere are left out; the files of the shuffles go with their step."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(20000)]
    fresh = lambda n: [rng.choice(pool) for _ in range(n)]
    passage = fresh(100)
    rows = [(i, " ".join(fresh(60) + (passage if i in (3, 7) else fresh(100)) + fresh(60))) for i in range(40)]
    texts = spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), "text")
    found = sorted((r.id, r.place) for r in chains._occurrences(texts).collect())
    assert found == [(i, p) for i in (3, 7) for p in (60, 154)]
    assert [(r.id, r.oid, r.place, r.oplace, r.near) for r in chains._matches(texts).orderBy("place").collect()] == [(7, 3, p, p, True) for p in (60, 154)]


@pytest.mark.parametrize("seed", range(3))
def test_hopeful_chains(seed):
    rng = np.random.default_rng(seed)
    a = [rng.integers(0, 30, n).astype(np.uint32) for n in rng.integers(1, 130, 40)]
    b = [rng.integers(0, 30, n).astype(np.uint32) for n in rng.integers(1, 130, 40)]

    def can(x, y):
        sums = np.append(0, np.cumsum(np.isin(x, y)))
        return any(10 * (sums[j] - sums[i]) >= 8 * (j - i) for i in range(len(x)) for j in range(i + chains.MIN_WORDS, len(x) + 1))

    assert chains.hopeful(a, b).tolist() == [can(x, y) for x, y in zip(a, b, strict=True)]
    assert chains.hopeful(a[:1], [np.zeros(0, np.uint32)]).tolist() == [False]


def matches(rows):
    columns = dict(zip(("id", "oid", "place", "oplace", "before", "on", "near"), zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_pydict({c: pa.array(x, pa.int32() if c in ("place", "oplace") else None) for c, x in columns.items()})


def test_chains_that_cannot_be_passages_are_left_out():
    def match(oid, place, oplace, near):
        return 9, oid, place, oplace, False, False, near

    found = [match(1, 10, 10, False), match(1, 30, 30, False), match(2, 10, 10, True), match(2, 30, 30, False), match(2, 700, 700, False),
             match(2, 720, 720, False), match(3, 5, 5, True), match(4, 5, 5, False)]
    for parts in ([found], [found[:3], found[3:]]):  # a pair may go on in the next batch
        out = [r for x in chains._chains(iter([matches(p) for p in parts])) for r in x.to_pylist()]
        assert sorted((r["oid"], r["a"], r["b"]) for r in out) == [(2, [10, 30], [10, 30]), (3, [5], [5])]


def test_texts_of_a_batch_are_as_if_alone(spark):
    rng = np.random.default_rng(3)
    stretch = "a b c " * 30  # periodic, at the end of one text and at the start of the next one
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, 200)) + " " + stretch, stretch + " ".join(f"w{x}" for x in rng.integers(0, 6, 120)), "short text", stretch]
    words = [chains.numbers(t.encode()) for t in texts if len(t.split()) >= chains.MIN_WORDS]
    starts = np.cumsum([0, *map(len, words)])
    seed, place, text = chains._all_seeds(np.concatenate(words), starts)
    alone = [np.concatenate(x) for x in zip(*(next(chains.seeds(w)) for w in words), strict=True)]
    assert seed.tolist() == alone[0].tolist() and (place - starts[text]).tolist() == alone[1].tolist()
    frequent = [np.flatnonzero(np.isin(s, seed[::7])) for s, _ in (next(chains.seeds(w)) for w in words)]
    together = chains._places(np.concatenate(words), np.concatenate([f + s for f, s in zip(frequent, starts, strict=False)]), starts)
    single = [(*r, i) for i, (w, f) in enumerate(zip(words, frequent, strict=True)) for r in zip(*(x.tolist() for x in chains._places(w, f)), strict=True)]
    number = np.searchsorted(starts, together[1], side="right") - 1
    assert sorted(zip(together[0].tolist(), (together[1] - starts[number]).tolist(), together[2].tolist(), together[3].tolist(), number.tolist(), strict=True)) == sorted(single)
