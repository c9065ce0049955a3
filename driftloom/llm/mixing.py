"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source takes as many complete epochs as fit its target, then documents in order of exponential keys,
scaled by their quality, until the rest of the target is full; the document in which it ends is taken in
part. Keys come from the document's number, so reruns agree. Null texts have size 0 and are taken with
0 words; documents of a null source are a source of their own, the last. Repeated rows count each for
itself. An empty table gives an empty mix. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import words, written

#: Weights of the sources in order of code point, repeating; share of all words to take;
#: the most that a document may be repeated.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
#: Quality weights of labelled documents, and of those without a label.
QUALITY = {0: 0.25, 1: 1.0}
UNLABELLED = 0.5
#: Parts of a source by key, so that its running sum is made in parts.
PARTS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to those and ``target``: weights shared out, none above ``most`` times its size.

    Sharing the excess again and again ends where every source has min(limit, weight x level); sources fill
    in order of limit by weight, so the level is found by one running sum. One row a source, so few rows.
    """
    by_code_point = W.orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(by_code_point) - 1) % len(weights) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), number).cast("double"))
    ranked = ranked.withColumn("limit", F.col("source_size").cast("double") * most)
    fill = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    # The first source, in order of filling, whose share stays within its limit sets the level for it and all after.
    first = F.min(F.when(F.col("open"), F.col("limit") / F.col("weight"))).over(everything)
    the_level = F.min(F.when(F.col("open") & (F.col("limit") / F.col("weight") == first), F.col("level"))).over(everything)
    target = F.when(F.col("limit") / F.col("weight") < first, F.col("limit")).otherwise(
        F.least(F.col("limit"), F.coalesce(the_level * F.col("weight"), F.col("limit")))
    )
    return ranked.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from a document's number: 52 bits of a digest."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    most: int = MOST_EPOCHS,
    parts: int = PARTS,
) -> DataFrame:
    """doc_id, print (hash of the text), size, source, source_size, target, taken (words), epochs, copies (whole documents).

    ``quality``: doc_id and quality (0 or 1); of several rows for a document the best counts. A document that
    is taken in part counts as one more copy when at least half of it is taken.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("print"), F.size(words(F.col("text"))).cast("bigint").alias("size"))
    worth = F.lit(1.0)
    if quality is not None:
        best = quality.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        sized = sized.join(best, "doc_id", "left")
        worth = F.lit(UNLABELLED)
        for value, weight in QUALITY.items():
            worth = F.when(F.col("quality") == value, F.lit(weight)).otherwise(worth)
    key = -F.log(uniform(F.col("doc_id"))) / worth
    sized = written(sized.select("doc_id", "source", "print", "size", key.alias("key")), "mix-sizes")

    # Below 1 and growing with the key: parts follow each other in order of key.
    part = F.floor((1 - F.exp(-F.col("key"))) * parts)
    rows = sized.withColumn("part", part).withColumn("name", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source")))
    by_part = rows.groupBy("name", "part").agg(F.sum("size").alias("part_size"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = goals.withColumn("name", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"))).drop("source")
    goals = goals.withColumn("goal", F.round("target").cast("bigint"))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    earlier = W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select("name", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before"))

    # A source has at most ``parts`` rows here; its documents meet them by source and part, not by source alone.
    within = W.partitionBy("name", "part").orderBy("key", "doc_id", "size", "print").rowsBetween(W.unboundedPreceding, -1)
    known = before.join(goals, "name")
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(known, ["name", "part"])
    room = F.col("rest") - F.col("before") - F.col("inside")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), room))
    whole = ((F.col("size") > 0) & (partly * 2 >= F.col("size"))).cast("bigint")
    return placed.select(
        "doc_id", "print", "size", "source", "source_size", "target",
        (F.col("epochs") * F.col("size") + partly).cast("bigint").alias("taken"),
        F.col("epochs").cast("bigint").alias("epochs"), (F.col("epochs") + whole).alias("copies"),
    )
