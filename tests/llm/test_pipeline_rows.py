"""The whole pipeline on a table with null ids and texts, repeated rows and columns whose names the stages use themselves."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm.common import durable

POOL = ["stone", "river", "of", "the", "and", "walking", "under", "light", "a", "house", "window", "green", "tree", "cold", "far", "slow"]


def sentence(rng, n):
    return " ".join(rng.choice(POOL, n)).capitalize() + "."


def test_odd_rows_through_all_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, sentence(rng, 120), "en", "s", 1) for i in range(80)]
    item = " ".join(f"planted{i}" for i in range(14))
    rows = good + [
        good[3], (500, good[3][1], "en", "s", 1), (None, sentence(rng, 130), "en", "s", 1), (501, None, "en", "s", None), (None, None, None, None, None),
        (502, "", "en", "s", 0), (503, sentence(rng, 60) + " " + item + " " + sentence(rng, 60), "en", "s", 1),
        (504, sentence(rng, 90) + " Write to jo.doe@mail.example.org now.", None, None, 1), (505, sentence(rng, 40_000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"row": F.lit(1), "s": F.lit("x"), "state": F.lit(2.0), "rid": F.lit(3), "at": F.lit(4), "span": F.lit(5)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, ""), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = durable(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        kept[name] = [r.doc_id for r in now.collect()]
    assert not {501, 502} & set(kept["quality"]) and {None, 3, 500, 503, 504} <= set(kept["quality"])
    assert kept["near_duplicates"].count(3) == 1 and 500 not in kept["near_duplicates"]
    assert set(kept["near_duplicates"]) - set(kept["decontaminate"]) == {503} and kept["pii"] == kept["decontaminate"]
    texts = {r.doc_id: r.text for r in now.collect()}
    assert "jo.doe" not in texts[504] and "<EMAIL>" in texts[504]
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, r.ids_crc32)
    for doc_id, text in texts.items():
        ids = [*tokens.encode(text, add_special_tokens=False).ids, 2]
        assert sum(n for _, n, _ in found[doc_id].values()) == len(ids)
        assert all(zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) == c for s, n, c in found[doc_id].values())
