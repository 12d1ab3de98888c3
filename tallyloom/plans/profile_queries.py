"""Counts, distributions and reports on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import profile, quality
from tallyloom.plans.ingest_queries import page_images
from tallyloom.plans.registry import query
from tallyloom.sources import files


@query("class_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def class_distribution(t):
    return profile.class_distribution(t.events, "event_type", "count")


def _with_gaps(t):
    """Documents with their labels; two of every five documents carry none, so the label columns hold nulls."""
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


_GAPS = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("table_profile", f"""
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns,
       CAST(count(*) * 6 - count(doc_id) - count(lang) - count(source) - count(n_chars) - count(quality) - count(toxic) AS BIGINT)
         AS missing_values
FROM {_GAPS}
""")
def table_profile(t):
    return profile.table_profile(_with_gaps(t))


@query("distinct_keys", "SELECT count(DISTINCT o_custkey) AS distinct_values FROM orders")
def distinct_keys(t):
    return profile.distinct_keys(t.orders, "o_custkey")


@query("distinct_keys_approx")
def distinct_keys_approx(t):
    return profile.distinct_keys(t.lineitem, "l_partkey", rsd=0.02)


@query("imbalance", """
WITH d AS (SELECT source || '-' || quality AS label, count(*) AS n
           FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT count(*) AS classes, (SELECT label FROM d ORDER BY n DESC, label LIMIT 1) AS majority_class,
       (SELECT label FROM d ORDER BY n, label LIMIT 1) AS minority_class, round(max(n) / min(n), 2) AS imbalance_ratio
FROM d
""")
def imbalance(t):
    labelled = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    return profile.imbalance(labelled.select(F.concat_ws("-", "source", "quality").alias("label")), "label")


@query("numeric_profile", """
SELECT count(*) - count(value) AS missing, round(avg(value), 2) AS mean, min(value) AS min, max(value) AS max FROM events
""")
def numeric_profile(t):
    return profile.numeric_profile(t.events, "value")


@query("value_counts", f"""
SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM {_GAPS} GROUP BY lang
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM {_GAPS} WHERE quality IS NOT NULL GROUP BY quality
UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM {_GAPS} WHERE toxic IS NOT NULL GROUP BY toxic
""")
def value_counts(t):
    return profile.value_counts(_with_gaps(t), ["lang", "quality", "toxic"])


@query("categorical_profile", """
WITH d AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2)
SELECT "column", count(*) AS distinct_values, first(value ORDER BY n DESC, value) AS top_value, max(n) AS top_count
FROM d GROUP BY 1
""")
def categorical_profile(t):
    return profile.categorical_profile(t.orders, ["o_orderpriority", "o_orderstatus"])


@query("category_share", """
SELECT count(*) FILTER (event_type = 'error') AS matching, count(*) AS rows,
       round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 2) AS share_pct FROM events
""")
def category_share(t):
    return profile.category_share(t.events, "event_type", "error")


@query("duplicate_groups", """
SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS unique_groups, count(*) - count(DISTINCT l_orderkey) AS duplicates
FROM lineitem
""")
def duplicate_groups(t):
    return profile.duplicate_groups(t.lineitem, "l_orderkey")


@query("folder_stats", """
WITH f AS (
  SELECT page_id % 16 AS folder,
         octet_length(encode(html)) AS bytes,
         CASE WHEN page_id % 5 < 4 THEN CAST(length(html) % 2000 + 1 AS INTEGER) END AS width,
         CASE WHEN page_id % 5 < 4 THEN CAST(length(url) + page_id % 7 AS INTEGER) END AS height
  FROM pages),
r AS (SELECT folder, width, height, count(*) AS n FROM f WHERE width IS NOT NULL GROUP BY ALL),
c AS (SELECT folder, count(*) AS k, first('(' || width || ', ' || height || ')' ORDER BY n DESC, width, height) AS common
      FROM r GROUP BY 1)
SELECT folder, count(*) AS count, max(width) AS max_width, min(width) AS min_width, max(height) AS max_height,
       min(height) AS min_height, any_value(k) AS unique_resolutions, CASE WHEN any_value(k) = 1 THEN 'Yes' ELSE 'No' END AS all_same_size,
       any_value(common) AS common_resolution, round(avg(bytes / 1024.0), 2) AS avg_file_size_kb,
       round(max(bytes / 1024.0), 2) AS max_file_size_kb, round(min(bytes / 1024.0), 2) AS min_file_size_kb,
       round(sum(bytes) / 1024.0 / 1024.0, 2) AS total_size_mb
FROM f JOIN c USING (folder) GROUP BY 1
""")
def folder_stats(t):
    scanned = files.scan_image_headers(page_images(t.pages)).select("page_id", "width", "height")
    sizes = t.pages.select("page_id", F.octet_length("html").alias("bytes"))
    return profile.folder_stats(
        scanned.join(sizes, "page_id").withColumn("folder", F.col("page_id") % 16))


@query("file_check", """
WITH lost AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)),
train AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))
SELECT 'part_1 images' AS "check", (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS count, 'OK' AS status
UNION ALL SELECT 'part_2 images', (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1), 'OK'
UNION ALL SELECT 'Train metadata rows', (SELECT count(*) FROM orders), 'OK'
UNION ALL SELECT 'Train missing images', n, CASE WHEN n = 0 THEN 'OK' ELSE 'FAIL' END FROM train
UNION ALL SELECT 'Test images on disk', (SELECT count(DISTINCT doc_id) FROM labels), 'OK'
UNION ALL SELECT 'Test metadata raw', (SELECT count(*) FROM documents), CASE WHEN n = 0 THEN 'OK' ELSE 'WARN' END FROM lost
UNION ALL SELECT 'Test metadata clean', (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), 'OK'
UNION ALL SELECT 'Known missing test images', n, CASE WHEN n = 0 THEN 'OK' ELSE 'WARN' END FROM lost
""")
def file_check(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"))
    return quality.file_check(
        {"part_1": customers.where("id % 2 = 0"), "part_2": customers.where("id % 2 = 1")},
        t.orders.select(F.col("o_custkey").alias("id")), customers,
        t.documents.select(F.col("doc_id").alias("id")), t.labels.select(F.col("doc_id").alias("id")))


@query("long_summary", f"""
WITH g AS (SELECT * FROM {_GAPS}),
counts AS (SELECT 'lang' AS c, lang AS v, count(*) AS n FROM g GROUP BY lang
           UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM g WHERE quality IS NOT NULL GROUP BY quality)
SELECT 'metadata' AS category, 'documents' AS source, metric, value FROM (
  SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM g
  UNION ALL SELECT 'columns', '6'
  UNION ALL SELECT 'missing_values', CAST(count(*) * 2 - count(quality) - count(toxic) AS VARCHAR) FROM g
  UNION ALL SELECT 'n_chars_missing', CAST(count(*) - count(n_chars) AS VARCHAR) FROM g
  UNION ALL SELECT 'n_chars_mean', CAST(round(avg(n_chars), 2) AS VARCHAR) FROM g
  UNION ALL SELECT 'n_chars_min', CAST(min(n_chars) AS VARCHAR) FROM g
  UNION ALL SELECT 'n_chars_max', CAST(max(n_chars) AS VARCHAR) FROM g
  UNION ALL SELECT 'unique_source', CAST(count(DISTINCT source) AS VARCHAR) FROM g
  UNION ALL SELECT 'duplicate_source', CAST(count(*) - count(DISTINCT source) AS VARCHAR) FROM g
  UNION ALL SELECT c || '_count_' || v, CAST(n AS VARCHAR) FROM counts
  UNION ALL SELECT c || '_unique', CAST(count(*) AS VARCHAR) FROM counts GROUP BY c
  UNION ALL SELECT c || '_majority', first(v ORDER BY n DESC, v) FROM counts GROUP BY c
  UNION ALL SELECT c || '_minority', first(v ORDER BY n, v) FROM counts GROUP BY c
  UNION ALL SELECT c || '_imbalance_ratio', CAST(round(max(n) / min(n), 2) AS VARCHAR) FROM counts GROUP BY c)
""")
def long_summary(t):
    return profile.profile(_with_gaps(t), "lang", ["n_chars"], ["quality"], "source", "documents")


_SPLIT = """(SELECT CASE WHEN substr(md5(CAST(o_custkey AS VARCHAR)), 1, 1) < '3' THEN 'val'
                         WHEN substr(md5(CAST(o_custkey AS VARCHAR)), 1, 1) < '6' THEN 'test' ELSE 'train' END AS split,
                    o_custkey, o_orderpriority, o_orderkey FROM orders)"""


def hashed_split(t):
    digit = F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 1)
    side = F.when(digit < "3", "val").when(digit < "6", "test").otherwise("train")
    return t.orders.select(side.alias("split"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("split_summary", f"""
SELECT split, 'size' AS metric, count(*) AS value FROM {_SPLIT} GROUP BY split
UNION ALL SELECT split, 'unique_groups', count(DISTINCT o_custkey) FROM {_SPLIT} GROUP BY split
UNION ALL SELECT split, 'label_' || o_orderpriority, count(*) FROM {_SPLIT} GROUP BY split, o_orderpriority
""")
def split_summary(t):
    return quality.split_summary(hashed_split(t), "split", "o_orderpriority", "o_custkey")


@query("split_validation", f"""
SELECT 'train' AS split, true AS "exists", count(*) AS rows, count(DISTINCT o_orderpriority) AS classes, '' AS missing_cols, true AS valid
FROM {_SPLIT} WHERE split = 'train'
UNION ALL SELECT 'val', true, count(*), count(DISTINCT o_orderpriority), 'image_id', false FROM {_SPLIT} WHERE split = 'val'
UNION ALL SELECT 'test', false, 0, 0, '', false
""")
def split_validation(t):
    named = hashed_split(t).withColumnsRenamed({
        "o_custkey": "lesion_id", "o_orderpriority": "label", "o_orderkey": "image_id"})
    train = named.where("split = 'train'").withColumn("image_path", F.concat_ws("/", "split", "image_id"))
    val = named.where("split = 'val'").withColumn("image_path", F.concat_ws("/", "split", "image_id")).drop("image_id")
    return quality.validate_splits(
        {"train": train, "val": val, "test": None}, ["image_id", "image_path", "label", "lesion_id"])


@query("split_schema_report", """
SELECT 'orders' AS split, true AS "exists", count(*) AS rows, count(DISTINCT o_orderpriority) AS classes, '' AS missing_cols, true AS valid FROM orders
UNION ALL SELECT 'lineitem', true, count(*), 0, 'o_orderkey,o_orderpriority', false FROM lineitem
""")
def split_schema_report(t):
    return quality.validate_splits(
        {"orders": t.orders, "lineitem": t.lineitem}, ["o_orderkey", "o_orderpriority"], "o_orderpriority")
