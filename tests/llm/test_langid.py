"""The recurrent network against a plain loop and numeric gradients; held-out accuracy; defined results for odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import langid
from tallyloom.llm.common import QUERIES


def double(classes=3, hidden=4, seed=1):
    net = langid.Network.fresh(hidden, classes, seed)
    return langid.Network(*(p.astype(np.float64) for p in net.parts()))


def plain(net, raw):
    """Probabilities at every byte of one chunk, byte by byte."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def walk(way, items):
        h, out = np.zeros(net.states.shape[-1]), []
        for b in items:
            z = sigmoid(net.inputs[way, 0, b] + h @ net.states[way, 0])
            r = sigmoid(net.inputs[way, 1, b] + h @ net.states[way, 1])
            c = np.tanh(net.inputs[way, 2, b] + r * (h @ net.states[way, 2]))
            h = h + z * (c - h)
            out.append(h)
        return out

    forward, backward = walk(0, raw), walk(1, raw[::-1])[::-1]
    logits = np.array([f @ net.out[0] + b @ net.out[1] + net.bias for f, b in zip(forward, backward, strict=True)])
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_pooled_over_all_positions(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 16)
    monkeypatch.setattr(langid, "SIDE", 5)
    net, rng = double(), np.random.default_rng(0)
    texts = [rng.bytes(n) for n in (0, 1, 15, 16, 17, 100, 333, 0, 7)]
    found = langid.document_probabilities(net, texts)
    for text, p in zip(texts, found, strict=True):
        parts = [plain(net, text[i:i + 16]) for i in range(0, len(text), 16)]
        assert np.allclose(p, np.concatenate(parts).mean(0) if parts else 0)


def test_gradients():
    net, rng = double(), np.random.default_rng(2)
    chunks, lengths, labels = rng.integers(97, 103, (3, 9)).astype(np.uint8), np.array([9, 4, 1]), np.array([0, 2, 1])
    _, grads = net.gradients(chunks, lengths, labels)
    for p, g in zip(net.parts(), grads, strict=True):
        for at in rng.permutation(np.flatnonzero(np.abs(g) > 1e-9))[:12]:
            old, eps = p.flat[at], 1e-6
            p.flat[at] = old + eps
            up = net.gradients(chunks, lengths, labels)[0]
            p.flat[at] = old - eps
            down = net.gradients(chunks, lengths, labels)[0]
            p.flat[at] = old
            assert g.flat[at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-9)


SYLLABLES = {"aa": ["ka", "mo", "ti", "lu"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["eau", "çé", "ou", "ll"]}


def planted(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(SYLLABLES)[int(rng.integers(0, 3))]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(4, 80))]
        out.append((i, " ".join(words), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 12)
    docs = planted(400)
    truth = {i: lang for i, _, lang in docs}
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "kamo " * 60_000, None), (None, "kamotilu kamo", "cc"),
           (1004, docs[0][1], None), (1004, docs[0][1], None), (1005, "ß", None)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").withColumns(
        {"h": F.lit(1), "chunk": F.lit(2), "score": F.lit(3), "held_out": F.lit(4)})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_language"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003].lang_pred == by_id[None].lang_pred == "aa" and by_id[1005].lang_pred in SYLLABLES
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (0, 1004)}) == 1


def test_ids_and_sources_are_no_inputs(spark):
    """The same texts under other ids and sources get the same results from the same model."""
    docs = planted(60)
    model = langid.fit(spark.createDataFrame([d[1:] for d in docs], "text string, lang string"))
    one = langid.predict(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), model).collect()
    two = langid.predict(spark.createDataFrame([(i + 999, t) for i, t, _ in docs], "doc_id long, text string"), model).collect()
    assert [r[1:] for r in one] == [r[1:] for r in two]


def test_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 3)
    rows = [("copy of one text", "aa")] * 50 + [(f"text {i}", "aa") for i in range(20)] + [("einzeln", "bb"), ("x" * 5000, "bb"), (None, "aa"), ("123", "cc"), ("none", None)]
    sample = langid.training_sample(spark.createDataFrame(rows, "text string, lang string")).collect()
    counts = {lang: sum(r.lang == lang for r in sample) for lang in ("aa", "bb", "cc")}
    assert counts == {"aa": 3, "bb": 1 + langid.SAMPLE_CHUNKS, "cc": 0}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    empty = spark.createDataFrame([], "text string, lang string")
    model = langid.fit(empty)
    assert [tuple(r) for r in langid.predict(docs, model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), model).collect() == []
