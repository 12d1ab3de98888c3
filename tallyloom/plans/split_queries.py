"""Group split and class balancing on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import keys, split
from tallyloom.operators.profile import class_distribution
from tallyloom.plans.ingest_queries import EVENT_TYPES
from tallyloom.plans.prepare import prepare
from tallyloom.plans.registry import query

def _mode_sql(source: str) -> str:
    return f"""
g AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM {source} GROUP BY ALL),
m AS (SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS o_orderpriority FROM g GROUP BY 1)
"""


def _split_sql(source: str) -> str:
    """CTEs that end in a(o_custkey, stratum, split)."""
    return f"""
{_mode_sql(source)},
st AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS size FROM m GROUP BY 1),
t AS (SELECT sum(size) AS total, ceil(0.15 * sum(size)) AS n_val FROM st),
q AS (SELECT o_orderpriority, size, size * (total - n_val) / total AS share, total - n_val AS n_train FROM st, t),
k AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, o_orderpriority) AS pos,
             n_train - sum(floor(share)) OVER () AS short FROM q),
v AS (SELECT o_orderpriority, size, size - floor(share) - CASE WHEN pos <= short THEN 1 ELSE 0 END AS n_val FROM k),
r AS (SELECT o_custkey, o_orderpriority,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_custkey), o_custkey) AS pos FROM m),
a AS (SELECT o_custkey, r.o_orderpriority AS stratum, CASE WHEN pos <= n_val THEN 'val' ELSE 'train' END AS split
      FROM r JOIN v ON r.o_orderpriority = v.o_orderpriority)
"""


_MODE = _mode_sql("orders")
_SPLIT = _split_sql("orders")


@query("group_mode", f"WITH {_MODE} SELECT o_custkey, o_orderpriority FROM m")
def group_mode(t):
    return split.group_mode(t.orders, "o_custkey", "o_orderpriority")


@query("stratified_group_split", f"WITH {_SPLIT} SELECT o_orderkey, orders.o_custkey, split FROM orders JOIN a ON orders.o_custkey = a.o_custkey")
def stratified_group_split(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return split.split_by_group(orders, "o_custkey", "o_orderpriority").drop("o_orderpriority")


@query("split_sizes", f"""
WITH {_SPLIT}
SELECT split, count(DISTINCT orders.o_custkey) AS unique_groups, count(*) AS rows, CAST(0 AS BIGINT) AS leaked_groups
FROM orders JOIN a ON orders.o_custkey = a.o_custkey GROUP BY 1
""")
def split_sizes(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    placed = split.split_by_group(orders, "o_custkey", "o_orderpriority")
    leaked = keys.leaked_groups(placed, "o_custkey").agg(F.count("*")).scalar()
    return placed.groupBy("split").agg(
        F.countDistinct("o_custkey").alias("unique_groups"), F.count("*").alias("rows")).withColumn("leaked_groups", leaked)


@query("prepared_summary", f"""
WITH found AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
{_split_sql('found')},
s AS (SELECT a.split, found.o_custkey, o_orderpriority FROM found JOIN a ON found.o_custkey = a.o_custkey)
SELECT split, 'size' AS metric, count(*) AS value FROM s GROUP BY 1
UNION ALL SELECT split, 'unique_groups', count(DISTINCT o_custkey) FROM s GROUP BY 1
UNION ALL SELECT split, 'label_' || o_orderpriority, count(*) FROM s GROUP BY split, o_orderpriority
""")
def prepared_summary(t):
    metadata = t.orders.select(
        F.col("o_orderkey").cast("string").alias("image_id"), F.col("o_custkey").alias("lesion_id"), F.col("o_orderpriority").alias("dx"))
    found = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("id"), F.concat_ws("/", "l_returnflag", "l_orderkey").alias("path"), "l_returnflag")
    return prepare(metadata, found, F.col("l_returnflag")).summary


_WEIGHTS = """
w AS (SELECT event_type, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 4) AS weight
      FROM events GROUP BY 1)
"""


@query("class_weights", f"WITH {_WEIGHTS} SELECT event_type, n, weight FROM w")
def class_weights(t):
    return split.class_weights(class_distribution(t.events, "event_type"), "event_type")


@query("weight_vector", f"""
WITH {_WEIGHTS}
SELECT CAST(unnest(range(5)) AS INTEGER) AS idx, unnest(list(weight ORDER BY event_type DESC)) AS weight FROM w
""")
def weight_vector(t):
    weights = split.class_weights(class_distribution(t.events, "event_type"), "event_type")
    vector = split.weight_vector(weights, "event_type", EVENT_TYPES[::-1])
    return vector.select(F.posexplode("weights").alias("idx", "weight"))


@query("row_weights", f"WITH {_WEIGHTS} SELECT event_id, events.event_type, weight FROM events JOIN w ON events.event_type = w.event_type")
def row_weights(t):
    return split.row_weights(t.events.select("event_id", "event_type"), "event_type")


@query("sample_per_class", """
SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
WHERE rn <= 2
""")
def sample_per_class(t):
    return split.first_per_class(t.embeddings.select("vec_id", "label"), "label", 2, ["vec_id"])
