"""Connected components of a graph given by its links, in DataFrames.

Alternates the large-star and small-star steps of Kiveris et al., "Connected
Components in MapReduce and Beyond" (2014).  Each step is a partial aggregation
(the least neighbour of a node) and a join whose one side has a row for each node,
so a hub's links are spread and pre-aggregated; nothing goes to the driver but two
numbers a round.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_MARK, discard, scratch, shuffles_end

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are tied to its least neighbour.  Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
    moved = links.join(least, F.col("b") == F.col("n")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.filter("a < b").unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its least node.

    ``links`` has long columns ``a`` and ``b``; loops, repeats and nulls are ignored.
    """
    spark = links.sparkSession
    links = links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    path, before = scratch(spark, "links"), None
    with shuffles_end(spark):
        links.distinct().write.options(**NO_MARK).parquet(path)
    for _ in range(MAX_ROUNDS):
        old, path = path, scratch(spark, "links")
        with shuffles_end(spark):
            _small_star(_large_star(spark.read.parquet(old))).write.options(**NO_MARK).parquet(path)
        discard(spark, old)
        now = spark.read.parquet(path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point was reached")
    stars = spark.read.parquet(path)
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
