"""Sources, projections, row rules and key checks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.columns import join_path, kilobytes, normalise
from tallyloom.operators import keys, quality
from tallyloom.operators.lookup import attach, decode, encode, risk_lookup
from tallyloom.operators.profile import class_distribution
from tallyloom.operators.split import class_weights
from tallyloom.plans.registry import query
from tallyloom.session import scratch_path
from tallyloom.sources import delimited, facts, files, reports
from tallyloom.streaming.events import read_events

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_CLASSES = [
    ("click", "Click", "LOW"), ("error", "Failed request", "HIGH"), ("purchase", "Purchase", "MEDIUM"),
    ("signup", "Registration", "LOW"),
]


@query("csv_roundtrip", f"""
SELECT doc_id, CASE WHEN text NOT IN ({", ".join(f"'{x}'" for x in delimited.NULL_TEXTS)}) THEN text END AS text, lang, source, n_chars FROM documents
""")
def csv_roundtrip(t):
    path = scratch_path(t.spark, "csv")
    delimited.write_csv(t.documents, path)
    return delimited.read_split_csv(t.spark, path, t.documents.schema)


@query("csv_numbers", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_numbers(t):
    path = scratch_path(t.spark, "csv")
    delimited.write_csv(t.orders, path)
    return delimited.read_split_csv(t.spark, path, t.orders.schema)


@query("json_report_roundtrip", """
WITH d AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 4) AS weight,
       CAST(sum(n) OVER () AS BIGINT) AS total
FROM d
""")
def json_report_roundtrip(t):
    counts = class_distribution(t.events.withColumnRenamed("event_type", "label"), "label")
    path = scratch_path(t.spark, "report")
    reports.write_report(reports.baseline_document(class_weights(counts, "label"), "label", EVENT_TYPES), path)
    document = reports.read_report(t.spark, path, reports.BASELINE_SCHEMA)
    total = document.select("total_train_samples").scalar()
    return reports.baseline_distribution(document).withColumn("total", total)


@query("file_inventory")
def file_inventory(t):
    return files.inventory(t.spark, t.folder, "*.parquet").select("folder", "id", "bytes")


def page_images(pages):
    """Bytes built from each page: a PNG header before the page text, a JPEG header behind two filler
    segments, or something unreadable. Width and height follow from the page."""
    width = (F.length("html") % 2000 + 1).cast("long")
    height = (F.length("url") + F.col("page_id") % 7).cast("long")

    def be(value, size):
        return F.unhex(F.lpad(F.hex(value), size * 2, "0"))

    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), be(width, 4), be(height, 4),
                   F.unhex(F.lit("0802000000")), F.encode("html", "UTF-8"))
    filler = F.encode("url", "UTF-8")
    jpeg = F.concat(
        F.unhex(F.lit("FFD8FFE1")), be(F.length(filler).cast("long") + 2, 2), filler,
        F.unhex(F.lit("FFE1")), be(F.length(filler).cast("long") + 2, 2), filler,
        F.unhex(F.lit("FFC0001108")), be(height, 2), be(width, 2), F.unhex(F.lit("03011100021101031101")))
    broken = F.concat(F.unhex(F.lit("FFD8FF00")), F.encode("url", "UTF-8"))
    kind = F.col("page_id") % 5
    content = F.when(kind.isin(0, 1), png).when(kind.isin(2, 3), jpeg).otherwise(broken)
    return pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("folder"), content.alias("content"))


@query("image_header_scan", """
SELECT page_id, split_part(url, '/', 3) AS folder,
       CASE WHEN page_id % 5 < 4 THEN CAST(length(html) % 2000 + 1 AS INTEGER) END AS width,
       CASE WHEN page_id % 5 < 4 THEN CAST(length(url) + page_id % 7 AS INTEGER) END AS height
FROM pages
""")
def image_header_scan(t):
    return files.scan_image_headers(page_images(t.pages)).drop("content")


@query("append_log", """
SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY 1
""")
def append_log(t):
    path = scratch_path(t.spark, "log")
    events = t.events
    facts.append(events.where("event_type = 'error'"), path, "ts")
    facts.append(events.where("event_type <> 'error'"), path, "ts")
    stored = facts.read_facts(t.spark, path, events.schema)
    return stored.groupBy("date").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("append_once", """
SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def append_once(t):
    """The events come in by a stream; then one of its batches is written again, as after a crash, and adds no row."""
    path, state = scratch_path(t.spark, "once"), scratch_path(t.spark, "once-state")
    events = read_events(t.spark, t.folder, t.events.schema, "events.parquet")
    facts.append_stream(events, path, state, "events", "ts")
    facts.append_once(read_batch(t), path, "events-0", "ts")
    stored = facts.read_facts(t.spark, path, t.events.schema)
    return stored.groupBy("date", "event_type").agg(F.count("*").alias("n"))


def read_batch(t):
    """What the first micro-batch of the stream brought."""
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("build_path", """
SELECT doc_id, 'data/raw/' || source || '/' || doc_id || '.txt' AS path, round(n_chars / 1024.0, 2) AS size_kb
FROM documents
""")
def build_path(t):
    return t.documents.select(
        "doc_id",
        join_path("data/raw", F.col("source"), F.col("doc_id").cast("string"), suffix=".txt").alias("path"),
        F.round(kilobytes("n_chars"), 2).alias("size_kb"))


@query("drop_unresolved", """
SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
""")
def drop_unresolved(t):
    found = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return keys.drop_unresolved(found, "quality")[0]


@query("unresolved_report", """
SELECT count(*) AS total, count(quality) AS kept, count(*) - count(quality) AS dropped
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def unresolved_report(t):
    found = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return keys.drop_unresolved(found, "quality")[1]


@query("resolved_counts", """
SELECT count(*) AS total, count(quality) AS kept, count(*) - count(quality) AS dropped, count(quality) AS written
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def resolved_counts(t):
    """Counted in the pass that writes the kept rows."""
    found = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    kept, counted = keys.resolved(found, "quality")
    return kept.agg(F.count("*").alias("written")).select(*[F.lit(n).cast("long").alias(c) for c, n in counted.items()], "written")


@query("label_index", """
SELECT event_id, event_type, CAST(list_position(['click','error','purchase','signup'], event_type) - 1 AS INTEGER) AS idx,
       CASE WHEN event_type <> 'view' THEN event_type END AS label
FROM events
""")
def label_index(t):
    classes = EVENT_TYPES[:4]
    encoded = encode(t.events.select("event_id", "event_type"), "event_type", classes)
    return decode(encoded, "idx", classes)


@query("risk_lookup", """
SELECT event_id, event_type,
       CASE event_type WHEN 'click' THEN 'Click' WHEN 'error' THEN 'Failed request' WHEN 'purchase' THEN 'Purchase'
            WHEN 'signup' THEN 'Registration' END AS display_name,
       CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'view' THEN NULL ELSE 'LOW' END AS risk_level,
       event_type = 'error' AS high_risk
FROM events
""")
def event_risk(t):
    dimension = t.spark.createDataFrame(EVENT_CLASSES, "label string, display_name string, risk_level string")
    return risk_lookup(t.events.select("event_id", "event_type"), "event_type", F.broadcast(dimension))


@query("nation_lookup", """
SELECT c_custkey, n_name, r_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def nation_lookup(t):
    places = t.nation.join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    places = places.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return attach(t.customer.select("c_custkey", "c_nationkey"), places, "c_nationkey").drop("c_nationkey")


@query("normalise_keys", r"""
SELECT c_custkey, lower(regexp_replace(chr(9) || ' ' || c_name || '  ' || chr(10), '^\s+|\s+$', '', 'g')) AS username,
       lower(c_mktsegment) AS segment
FROM customer
""")
def normalise_keys(t):
    padded = F.concat(F.lit("\t "), F.col("c_name"), F.lit("  \n"))
    return t.customer.select("c_custkey", normalise(padded).alias("username"), normalise("c_mktsegment").alias("segment"))


def customer_rules():
    return {
        "name_too_short": quality.min_length("c_mktsegment", 9, trimmed=True),
        "segment_unknown": quality.one_of("c_mktsegment", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]),
        "balance_out_of_range": quality.between("c_acctbal", 0, 9000),
    }


@query("validate_rows", """
SELECT c_custkey,
       concat_ws(',', CASE WHEN length(trim(c_mktsegment)) < 9 THEN 'name_too_short' END,
                 CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE','BUILDING','HOUSEHOLD','MACHINERY') THEN 'segment_unknown' END,
                 CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'balance_out_of_range' END) AS reasons,
       length(trim(c_mktsegment)) >= 9 AND c_mktsegment IN ('AUTOMOBILE','BUILDING','HOUSEHOLD','MACHINERY')
         AND c_acctbal BETWEEN 0 AND 9000 AS ok
FROM customer
""")
def validate_rows(t):
    checked = quality.check_rows(t.customer, customer_rules())
    return checked.select("c_custkey", F.concat_ws(",", "reasons").alias("reasons"), "ok")


@query("quarantine_counts", """
SELECT reason, count(*) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN length(trim(c_mktsegment)) < 9 THEN 'name_too_short' END,
                 CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE','BUILDING','HOUSEHOLD','MACHINERY') THEN 'segment_unknown' END,
                 CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'balance_out_of_range' END], lambda x: x IS NOT NULL)) AS reason
  FROM customer) GROUP BY 1
""")
def quarantine_counts(t):
    bad = quality.split_good_bad(t.customer, customer_rules())[1]
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("validate_predictions", """
SELECT event_id,
       concat_ws(',', CASE WHEN event_type NOT IN ('click','purchase','signup','view') THEN 'class_unknown' END,
                 CASE WHEN NOT (value > 0 AND value <= 100) THEN 'confidence_out_of_range' END) AS reasons
FROM events
""")
def validate_predictions(t):
    rules = {
        "class_unknown": quality.one_of("event_type", ["click", "purchase", "signup", "view"]),
        "confidence_out_of_range": quality.between("value", 0, 100, open_low=True),
        "id_missing": quality.has_value("event_id"),
    }
    return quality.check_rows(t.events, rules).select("event_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("resolve_first_match", """
SELECT o_orderkey, min_by(path, rank) AS path FROM orders LEFT JOIN (
  SELECT l_orderkey, l_returnflag || '/' || l_linenumber || '-' || l_partkey AS path,
         row_number() OVER (ORDER BY l_returnflag, l_linenumber, l_returnflag || '/' || l_linenumber || '-' || l_partkey) AS rank
  FROM lineitem) ON o_orderkey = l_orderkey
GROUP BY 1
""")
def resolve_first_match(t):
    path = F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"))
    found = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber", path.alias("path"))
    return keys.resolve_first_match(
        t.orders.select("o_orderkey"), found, "o_orderkey", "path", ["l_returnflag", "l_linenumber"])


@query("missing_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(t):
    return keys.missing_keys(t.documents, t.labels, "doc_id")


@query("present_keys", "SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def present_keys(t):
    return keys.present_rows(t.documents.select("doc_id", "source", "lang"), t.labels, "doc_id")


@query("leakage_check", """
WITH s AS (SELECT o_custkey, CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '4' THEN 'val' ELSE 'train' END AS split
           FROM orders)
SELECT o_custkey, min(split) AS first_split, max(split) AS last_split FROM s GROUP BY 1 HAVING min(split) <> max(split)
""")
def leakage_check(t):
    side = F.when(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1) < "4", "val").otherwise("train")
    return keys.leaked_groups(t.orders.select("o_custkey", side.alias("split")), "o_custkey")


@query("group_overlap", """
SELECT o_custkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '4'
INTERSECT SELECT o_custkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) >= '4'
""")
def group_overlap(t):
    val = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1) < "4"
    return keys.overlap(t.orders.where(val), t.orders.where(~val), "o_custkey")


@query("class_diff", """
SELECT coalesce(a.k, b.k) AS orderkey, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'unseen' END AS status
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey + 1 AS k FROM lineitem) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL
""")
def class_diff(t):
    baseline = t.orders.select(F.col("o_orderkey").alias("orderkey"))
    return keys.class_diff(baseline, t.lineitem.select((F.col("l_orderkey") + 1).alias("orderkey")), "orderkey")


@query("class_match", """
WITH w AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup']) AS k), f AS (SELECT DISTINCT event_type AS k FROM events)
SELECT (SELECT count(*) FROM f) AS class_count, (SELECT string_agg(k, ',' ORDER BY k) FROM w SEMI JOIN f USING (k)) AS found_expected,
       (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM w ANTI JOIN f USING (k)) AS missing_classes,
       (SELECT count(*) FROM f ANTI JOIN w USING (k)) AS unseen_count,
       (SELECT count(*) FROM f ANTI JOIN w USING (k)) + (SELECT count(*) FROM w ANTI JOIN f USING (k)) = 0 AS classes_match
""")
def class_match(t):
    return keys.class_match(t.events, "event_type", ["signup", "click", "error", "purchase", "refund"])


@query("integrity_report", """
SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM events)) AS columns,
       6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props) AS missing_values,
       count(DISTINCT user_id) AS unique_groups, count(DISTINCT event_type) AS class_count,
       list_sort(list(DISTINCT event_type)) = ['click', 'error', 'purchase', 'signup', 'view'] AS classes_match
FROM events
""")
def integrity_report(t):
    return quality.check_integrity(t.events, "event_type", "user_id", EVENT_TYPES)


@query("union_keys", "SELECT o_custkey AS custkey FROM orders UNION SELECT c_custkey FROM customer")
def union_keys(t):
    return keys.union_keys(
        "custkey", t.orders.select(F.col("o_custkey").alias("custkey")), t.customer.select(F.col("c_custkey").alias("custkey")))


@query("orphan_links", """
SELECT o_orderkey, o_custkey, l.k IS NOT NULL AS linked
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k
""")
def orphan_links(t):
    return keys.link_check(t.orders.select("o_orderkey", "o_custkey"), t.lineitem, "o_orderkey", "l_orderkey")
