"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join back; both are spread by key, hubs are pre-aggregated and AQE splits the
join at a hub. The number of rounds grows with the logarithm of the component size, each is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import durable


def _least(pairs: DataFrame) -> DataFrame:
    """For each a the smallest of a and its neighbours; the round-robin step lets AQE split hubs."""
    return pairs.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")).repartition(_tasks(pairs))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(_least(both), "a").filter("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = down.join(_least(down), "a")
    pairs = linked.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p"))
    return pairs.filter("p.b <> p.m").select(F.col("p.b").alias("a"), F.col("p.m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest node. Loops are ignored."""
    edges = durable(edges.select("a", "b").filter("a <> b").distinct())
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = state
        edges = durable(_small_star(_large_star(edges)))
