"""Connected components over a table of links, as a loop of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, remove, written


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node named in ``links(a, b)``; the
    component is the smallest node reachable. Nulls and self-links are ignored; no
    links give no rows. Alternates large-star and small-star rewiring, which is
    logarithmic in practice; each round is written to the shared folder, the one before is
    deleted, and what meets the driver is one checksum a round."""
    spark = links.sparkSession
    path = new_path(spark, "links")
    edges = written(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
        path,
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        last, path = path, new_path(spark, "links")
        edges = written(small.where("a <> b").distinct(), "links", path)
        remove(spark, last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
