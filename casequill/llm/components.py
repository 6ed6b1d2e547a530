"""Connected components of a graph given as a table of links.

Every round replaces links by links to smaller ids (large-star, then small-star), until all
members of a component link to its smallest id. Rounds grow with the logarithm of the longest
path. Each round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequill.operators.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Links run from larger ``a`` to smaller ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)`` that is not itself the smallest of its component."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = stage(links)
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        now = stage(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def with_least_id(classes: DataFrame, reached: DataFrame) -> DataFrame:
    """``classes(name, low, ...)`` with ``least``, the smallest ``low`` of the component of ``name``; null where all are null."""
    whole = classes.join(reached.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    # lone classes need no look at others
    lows = whole.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    return whole.join(lows, "component", "left").withColumn("least", F.coalesce("least", "low")).drop("component")
