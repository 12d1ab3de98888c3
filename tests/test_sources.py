import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.profile import folder_stats
from tallyloom.plans import prepare, serving
from tallyloom.sources import delimited, facts, files, reports
from tallyloom.streaming.events import read_events


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    chunk = b"IHDR" + head
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + chunk + struct.pack(">I", zlib.crc32(chunk))


def jpeg(width, height, filler=20, segments=1):
    app = b"\xff\xe1" + struct.pack(">H", filler + 2) + b"\x00" * filler
    return b"\xff\xd8" + app * segments + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00\xff\xda\x00\x02"


BAD = {"empty": b"", "text": b"hello world", "corrupt": b"\xff\xd8\xff\x00garbage", "short": png(5, 5)[:20], "cut": b"\xff\xd8\xff\xc0\x00\x0b\x08"}


def test_image_headers(spark):
    data = {"png": png(600, 450), "jpeg": jpeg(640, 480), "late": jpeg(1, 2, 60_000, 3), **BAD}
    df = spark.createDataFrame(list(data.items()), "name string, content binary")
    found = {r["name"]: (r["width"], r["height"]) for r in files.scan_image_headers(df).collect()}
    assert found == {"png": (600, 450), "jpeg": (640, 480), "late": (1, 2), **{k: (None, None) for k in BAD}}


def test_listing_and_folder_statistics(spark, tmp_path):
    for folder, names in {"part_1": ["a.jpg", "b.jpg", "note.txt"], "part_2": ["c.jpg"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(jpeg(600, 450) if n != "b.jpg" else b"broken")
    listed = files.inventory(spark, str(tmp_path))
    assert {(r["folder"], r["id"]) for r in listed.collect()} == {("part_1", "a"), ("part_1", "b"), ("part_2", "c")}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert files.inventory(spark, str(tmp_path / "part_1"), "*").count() == 3
    scanned = files.scan_image_headers(files.read_contents(spark, str(tmp_path)))
    stats = {r["folder"]: r for r in folder_stats(scanned).collect()}
    assert (stats["part_1"]["count"], stats["part_1"]["unique_resolutions"], stats["part_1"]["common_resolution"]) == (2, 1, "(600, 450)")


def test_csv_null_texts_and_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('id,age,sex,note\n1,NA,male,"a, ""b"""\n2,,NA,x\n3,41.5,nan,\n')
    df = delimited.read_csv(spark, str(path), "id int, age double, sex string, note string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, "male", 'a, "b"'), (2, None, None, "x"), (3, 41.5, None, None)]
    delimited.write_csv(df, str(tmp_path / "out"))
    again = delimited.read_csv(spark, str(tmp_path / "out"), "id int, age double, sex string, note string")
    assert [tuple(r) for r in again.orderBy("id").collect()] == [tuple(r) for r in df.orderBy("id").collect()]


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    parts = ["a", '"', "\n", ",", " ", "\r\n", "é", '""', "\n\n", "x" * 40, "NA"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))) or None, rng.choice([None, "plain", "two\nlines"])) for i in range(700)]
    rows.append((700, "long\n" * 3000, "crosses many blocks"))
    rows += [(701 + i, "one line each", None) for i in range(600)]
    schema = "id int, a string, b string"
    path = str(tmp_path / "one")
    delimited.write_csv(spark.createDataFrame(rows, schema).coalesce(1), path)
    want = sorted(map(tuple, delimited.read_csv(spark, path, schema).collect()))
    assert len(want) == len(rows)
    for size in ("700", "5000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            for bound in (0, 50_000):
                monkeypatch.setattr(delimited, "BROADCAST_BLOCKS", bound)
                assert sorted(map(tuple, delimited.read_split_csv(spark, path, schema).collect())) == want
            blocks = spark.read.text(path).select("_metadata.file_block_start").distinct().count()
            assert blocks > 5 or size == "100000000"
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_csv_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    delimited.write_csv(spark.createDataFrame([], "id int, a string"), path)
    assert delimited.read_split_csv(spark, path, "id int, a string").count() == 0
    (tmp_path / "crlf.csv").write_bytes(b'id,a\r\n1,"x\r\ny"\r\n\r\n2,z\r\n3,"open')
    found = delimited.read_split_csv(spark, str(tmp_path / "crlf.csv"), "id int, a string").collect()
    assert sorted(map(tuple, found))[:2] == [(1, "x\r\ny"), (2, "z")]


def test_appended_facts_and_day_pruning(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(3).select(
        F.lit("u").alias("uid"), F.lit("/predict").alias("endpoint"),
        F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(id as int))").alias("timestamp"))
    facts.append(rows, path)
    facts.append(rows.where("timestamp < '2024-01-02'"), path)
    back = facts.read_facts(spark, path, facts.REQUEST_LOG)
    assert back.count() == 4
    plan = back.where("date = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_report_text(spark):
    assert reports.as_text(spark.range(1)).first()["report"] == '{"id":0}'


def test_prepare_end_to_end(spark, tmp_path):
    meta = spark.range(600).select(
        F.concat(F.lit("I"), "id").alias("image_id"), F.concat(F.lit("L"), (F.col("id") / 2).cast("int")).alias("lesion_id"),
        F.when(F.col("id") % 10 < 7, "nv").otherwise("mel").alias("dx"))
    found = meta.where("image_id <> 'I5'").select(
        F.col("image_id").alias("id"), F.explode(F.array(F.lit("part_1"), F.lit("part_2"))).alias("folder"))
    found = found.where("NOT (id = 'I1' AND folder = 'part_1')").withColumn("path", F.concat_ws("/", "folder", F.concat("id", F.lit(".jpg"))))
    test = spark.createDataFrame([("T1", "X", "nv"), ("T2", "X", "mel")], "image_id string, lesion_id string, dx string")
    on_disk = spark.createDataFrame([("T1",)], "id string")
    done = prepare.prepare(meta, found, F.col("folder"), test, on_disk)
    assert tuple(done.unresolved.first()) == (600, 599, 1)
    paths = {r["image_id"]: r["image_path"] for r in done.splits.collect()}
    assert paths["I0"] == "part_1/I0.jpg" and paths["I1"] == "part_2/I1.jpg" and "I5" not in paths
    assert paths["T1"] == "test/T1.jpg" and "T2" not in paths
    summary = {(r["split"], r["metric"]): r["value"] for r in done.summary.collect()}
    assert summary[("val", "unique_groups")] == 45 and summary[("train", "unique_groups")] == 255 and summary[("test", "size")] == 1
    baseline = done.baseline.first()
    assert baseline["total_train_samples"] == summary[("train", "size")]
    prepare.save(done, str(tmp_path))
    train = delimited.read_csv(spark, str(tmp_path / "train.csv"), "image_id string, image_path string, label string, lesion_id string")
    assert train.count() == summary[("train", "size")]
    stored = reports.read_report(spark, str(tmp_path / "baseline_stats.json"), reports.BASELINE_SCHEMA).first()
    assert stored["class_weights"] == baseline["class_weights"]


def test_requests_become_facts_and_metrics(spark):
    hour = "timestamp'2024-01-01 10:00:00'"
    requests = spark.range(4).select(
        F.concat(F.lit("p"), "id").alias("prediction_id"), F.lit("u").alias("uid"), F.lit("ann").alias("username"),
        F.when(F.col("id") > 0, "x.jpg").alias("image_filename"), F.lit(2048).cast("long").alias("image_bytes"),
        F.lit(0.1234567).alias("inference_s"), F.expr(f"{hour} + make_interval(0,0,0,0,0,cast(id as int))").alias("timestamp"),
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == F.when(F.col("id") == 0, 4).otherwise(5), 9.0).otherwise(0.0)).alias("logits"))
    stored = serving.prediction_facts(requests)
    found = {r["prediction_id"]: r for r in serving.prediction_rows(stored).collect()}
    assert (found["p0"]["predicted_class"], found["p0"]["risk_level"], found["p0"]["inference_ms"]) == ("mel", "HIGH", 123.46)
    assert found["p1"]["predicted_class"] == "nv" and set(found["p1"]["all_scores"]) == {"akiec", "bcc", "bkl", "df", "mel", "nv", "vasc"}
    images = {r["prediction_id"]: r for r in serving.image_rows(stored).collect()}
    assert (images["p0"]["filename"], images["p1"]["image_size_kb"]) == ("unknown.jpg", 2.0)
    log = serving.request_rows(stored)
    assert sorted((r["requests"], r["breach"]) for r in log.collect()) == [(1, False), (2, False), (3, True), (4, True)]
    counted = serving.metric_samples(stored, log).groupBy("metric").count()
    assert {r["metric"]: r["count"] for r in counted.collect()} == {
        "api_requests_total": 4, "images_processed_total": 4, "predictions_total": 4, "prediction_confidence": 4,
        "inference_latency_seconds": 4, "user_predictions_total": 4, "high_risk_predictions_total": 1, "user_rate_limit_breach_total": 2}


def test_failures_count_by_type(spark):
    df = spark.createDataFrame([("http", "/predict"), ("internal", "/explain")], "error_type string, endpoint string").withColumn("ts", F.current_timestamp())
    found = {(r["metric"], tuple(sorted(r["labels"].items()))) for r in serving.failure_samples(df).collect()}
    assert ("images_processed_total", (("status", "failed"),)) in found and len(found) == 5
    assert ("api_requests_total", (("endpoint", "/explain"), ("method", "POST"), ("status_code", "500"))) in found


def test_csv_keeps_text(spark, tmp_path):
    data = [(1, "  outer blanks "), (2, "line\nbreak, \"quoted\" \\ and\r\ncomma,"), (3, None), (4, ""), (5, "\n"), (6, "NA"), (7, "a\tb'c")]
    df = spark.createDataFrame(data, "k long, text string")
    delimited.write_csv(df, str(tmp_path / "t"))
    found = {r["k"]: r["text"] for r in delimited.read_csv(spark, str(tmp_path / "t"), df.schema).collect()}
    assert found == {k: None if v in (None, "", "NA") else v for k, v in data}


def test_document_counts_unlisted_labels(spark):
    from tallyloom.sources import reports

    rows = spark.createDataFrame([("a", 3, 0.5), ("b", 1, 2.0), ("z", 4, 1.0)], "label string, n long, weight double")
    doc = reports.baseline_document(rows, "label", ["a", "b", "c"]).first()
    assert doc["class_distribution"] == {"a": 3, "b": 1} and doc["class_weights"] == {"a": 0.5, "b": 2.0}
    assert doc["total_train_samples"] == 8 and doc["unlisted_samples"] == 4


def test_a_crashed_append_leaves_every_row_once(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, timestamp timestamp"
    made = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"))
    for part in range(4):
        made.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(source)
    stream = read_events(spark, source, made.schema, files_per_trigger=1)
    whole, calls = facts.append_once, []

    def breaks(df, path, batch, ts="timestamp"):
        whole(df, path, batch, ts)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(facts, "append_once", breaks)
    with pytest.raises(Exception, match="lost after the write"):
        facts.append_stream(stream, out, state, "s")
    assert facts.append_stream(stream, out, state, "s") >= 3 and calls[1] == calls[2]
    facts.append_stream(stream, out, state, "s")
    found = facts.read_facts(spark, out, schema)
    assert sorted(r.id for r in found.collect()) == list(range(100)) and len(calls) == 5
    whole(made.limit(0).union(made.where("id < 7")), out, "other-0")
    assert facts.read_facts(spark, out, schema).count() == 107
