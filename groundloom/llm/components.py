"""Connected components of a table of links, by alternating large and small stars.

Every round is two groupings and two joins on a node. A node of many links is pre-aggregated by the grouping; the minima are written before
they are joined, so that both sides of the join are plain shuffles and Spark can split a hub's links over tasks.
Rounds grow with the logarithm of the longest path. Each round's links go to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundloom.session import cut_lineage


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``links`` (a, b; any orderable type).

    Links to itself and repeated links change nothing; links with a null end are left out; no links give an empty table.
    """
    e = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    mark = _mark(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = cut_lineage(both.join(low, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = large.join(least, F.col("a") == F.col("u"))
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        e = cut_lineage(small.select(ends.alias("x")).select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
