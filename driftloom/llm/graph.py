"""Connected components of links, as joins and minima: no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import written


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the links (a, b).

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds that
    grows as the logarithm of the size; then every link goes from a node to the smallest of its component.
    Every round is written to the shared folder. Null ends and links of a node to itself are left out.
    """
    ends = links.select("a", "b").filter(F.col("a") != F.col("b"))
    links = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _fingerprint(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.filter(F.col("a") != F.col("b")).distinct()

        lowest = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(lowest, "a")
        moved = smaller.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
