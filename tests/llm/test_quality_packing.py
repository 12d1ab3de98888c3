"""Quality rules and packing against brute force, with their defined results for odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import packing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def repeated(words, width=8):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i:i + width]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + width)})


@pytest.mark.parametrize("n", range(40))
def test_repeated_words(n):
    rng = np.random.default_rng(n)
    words = [b"%d" % w for w in rng.integers(0, 2 + n % 3, rng.integers(0, 60))]
    assert quality.repeated_words(words) == repeated(words)


def test_text_counts():
    assert quality.text_counts("a# b\n\n \na# b\nc\u00a0d é") == (6, 10, 2, 1, 0, 0, 0)
    assert quality.text_counts(None) == quality.text_counts("") == (0,) * 7


def test_chi2_quantile():
    assert quality.chi2_quantile(0.975, 6) == pytest.approx(14.449, abs=1e-3)


def sentences(n, seed=0):
    rng = np.random.default_rng(seed)
    pool = ["stone", "river", "of", "the", "and", "walking", "under", "light", "a", "house", "window", "green"]
    return [" ".join(rng.choice(pool, rng.integers(30, 200))).capitalize() + "." for _ in range(n)]


def test_rejects_outliers_only(spark):
    good = [(i, t, "en", "s", len(t)) for i, t in enumerate(sentences(300))]
    bad = [(1000 + i, "ZZ## QQ$$ " + " ".join(f"X{i}{j}%%%" for j in range(80)), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(good + bad, DOCS)
    kept = {r.doc_id for r in quality.keep_inliers(docs).collect()}
    assert kept == {r[0] for r in good if not quality.text_counts(r[1])[4] * 100 > 30 * quality.text_counts(r[1])[0]}


def brute_distances(x):
    """The robust distances of one cell in plain NumPy: concentration steps by the exact nearest three quarters of the rows."""
    steps, floors = quality.STEPS, np.array(quality.FLOORS)
    x = np.round(x * steps) / steps
    low, mid, high = (np.quantile(x, q, axis=0) for q in (0.25, 0.5, 0.75))
    off = (x - mid) / np.maximum((high - low) / 1.349, floors)
    results = []
    for near in ((off**2).sum(1), np.abs(off).max(1) ** 2):
        for _ in range(quality.C_STEPS + 1):
            core = x[np.argsort(near, kind="stable")[:int(np.ceil(quality.CORE_SHARE * len(x)))]]
            cov = np.cov(core.T, bias=True) + np.diag(floors**2)
            near = np.einsum("ni,ij,nj->n", x - core.mean(0), np.linalg.inv(cov), x - core.mean(0))
        results.append((np.linalg.slogdet(cov)[1], len(results), near))
    return min(results, key=lambda r: r[:2])[2]


def test_estimate_against_plain_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(sentences(500, 1))]
    rows += [(600 + i, " ".join(f"Wo{rng.integers(9)}{'#' * int(rng.integers(1, 9))}" for _ in range(60)), "en", "s", 0) for i in range(60)]
    counted = quality.with_counts(spark.createDataFrame(rows, DOCS), "s")
    out = quality.judged(counted, quality.estimates(counted.select("lang", "source", "s"))).filter("not base_failed").collect()
    share = lambda r, c: np.log1p(100 * r.s[c] / (r.s.n_words + 20))
    x = np.array([[
        np.log1p(r.s.n_words), np.log((r.s.word_chars + 100) / (r.s.n_words + 20)), share(r, "n_symbols"), share(r, "n_upper"), share(r, "n_marks"),
        share(r, "n_repeat_words")] for r in out])
    exact = brute_distances(x)
    limit = quality.chi2_quantile(quality.CUTOFF_P, quality.P) * quality.consistency(quality.CORE_SHARE)
    assert [r.kept for r in out] == (exact <= limit).tolist()
    assert {r.doc_id for r in out if not r.kept} == {r.doc_id for r in out if r.doc_id >= 600}
    assert np.corrcoef(np.log([r.d2 for r in out]), np.log(exact))[0, 1] > 0.99


def test_tables_in_plain_text_stay(spark):
    """Lone bars between the words of few documents are no noise; the same share of bars inside words is."""
    good = [(i, t, "en", "s", 0) for i, t in enumerate(sentences(300, 2))]
    tables = [(500 + i, t.replace(" ", " | "), "en", "s", 0) for i, t in enumerate(sentences(10, 3))]
    noise = [(600 + i, t.replace(" ", "||| "), "en", "s", 0) for i, t in enumerate(sentences(10, 4))]
    assert quality.borders("a | b|c |\n| d") == 3 and quality.borders(None) == quality.borders("||") == 0
    kept = {r.doc_id for r in quality.keep_inliers(spark.createDataFrame(good + tables + noise, DOCS)).collect()}
    assert kept >= {r[0] for r in good + tables} and not kept & {r[0] for r in noise}


def test_quality_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 200_000, None, "s", 1), *((9, t, None, "s", 1) for t in sentences(60))]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"s": F.lit(1), "row": F.lit(2), "at": F.lit(3), "kept": F.lit(4)})
    kept = quality.keep_inliers(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {9}
    assert quality.keep_inliers(docs.limit(0)).count() == 0


def best_fit(sizes, length, places):
    bins, out = [], []  # open bins: [free, number]
    made = 0
    for s in sizes:
        fits = [b for b in bins if b[0] >= s]
        if fits:
            b = min(fits)
        else:
            if len(bins) == places:
                bins.remove(min(bins))
            b = [length, made]
            made += 1
            bins.append(b)
        out.append(length - b[0])
        b[0] -= s
        if not b[0]:
            bins.remove(b)
    return out, made


@pytest.mark.parametrize("places", [1, 3, 50])
def test_packer(places):
    rng = np.random.default_rng(places)
    sizes = rng.integers(1, 20, 400).tolist()
    packer = packing.Packer(20, places)
    spots = [packer.place(s) for s in sizes]
    offsets, made = best_fit(sizes, 20, places)
    assert packer.made == made and [o for _, o in spots] == offsets


def test_cuts():
    assert packing.cuts(1) == [(0, 1)]
    assert packing.cuts(1024) == [(0, 1024)]
    assert packing.cuts(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def test_same_ids_as_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "Hello  world\n\n x", "é\u00a0ü 😀\u0000", "<|endoftext|>", " " * 3000 + "a", "a1b2 c's 'LL", "a <|endoftext|> b",
             "<|endoftext|><|endoftext|>x\n<|endoftext|", "<|ENDOFTEXT|>", " \n" * 60_000 + "end", "word, " * 30_000 + "<|endoftext|>" + "y" * 120_000]
    for text in texts:
        assert packing.encoder()(text) == slow.encode(text, add_special_tokens=False).ids
    assert packing.encoder()("a <|endoftext|> b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("task_pieces", [5, 200_000])
def test_packing(spark, monkeypatch, task_pieces):
    monkeypatch.setattr(packing, "TASK_PIECES", task_pieces)
    texts = [*sentences(60), None, "", "", "tok " * 9000]
    rows = [(i % 50, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "x", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit(1), "sequence_id": F.lit("x")})
    out = packing.packed_documents(docs).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = [*packing.encoder()(text or ""), 2]
        expected += [(doc_id, i, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cuts(len(ids)))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, expected)) == sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert packing.packed_documents(docs.limit(0)).count() == 0
