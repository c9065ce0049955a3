"""Ordered windows that survive a hot key.

A plain window puts every row of a key into one task. Here rows are range-partitioned by key and order
into segments of about ``width`` rows, whatever the keys and however far apart the sequence numbers are:
a hot key is spread over many segments, and small keys share one. Each segment is windowed on its own;
what must flow from one segment of a key to the next (a last value, a running total) is aggregated with
map-side combine to one row per key and segment, windowed per key over those few rows (at most as many
as there are segments), and joined back on (key, segment), on which the rows are already partitioned.

The segments are written to the shared folder, so that every reader sees the same borders; counting and
writing run while the plan is being built. A table of at most ``width`` rows is one plain window. Pass
narrow rows: whatever is in them is moved and sorted; texts are joined back by their sequence number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.sources.tables import written

SEGMENT_ROWS = 1 << 20
_SEG = "_segment"
_CARRY = "_carry"


def segment_of(order: Column, width: int) -> Column:
    """Segments of a dense number, such as a position that was counted."""
    return F.floor(order / F.lit(width))


def cut(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame | None:
    """The rows with their segment, written; None if one segment is enough."""
    parts = -(-df.count() // width)
    if parts <= 1:
        return None
    ranged = df.repartitionByRange(parts, *keys, order)
    return written(ranged.withColumn(_SEG, F.spark_partition_id()), "segments")


def _carry_join(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Bring each segment's carried value to its rows. Plain equality keeps the rows' partitioning,
    so only the few carry rows move; keys must not be null."""
    return rows.join(carry, [*keys, _SEG], "left")


def lag_over(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    width: int = SEGMENT_ROWS,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Previous non-null ``value`` of the same key in ``order``; null for a key's first row.

    ``seed`` (keys and value, one row per key) stands before a key's first row. It is joined to the
    few carry rows, so the rows themselves are not shuffled again for it.
    """
    tagged = cut(df, keys, order, width)
    if tagged is None:
        plain = df.withColumn(out, F.lag(value).over(W.partitionBy(*keys).orderBy(order)))
        if seed is None:
            return plain
        before = seed.select(*keys, F.col(value).alias(_CARRY))
        return plain.join(before, keys, "left").withColumn(out, F.coalesce(out, _CARRY)).select(*df.columns, out)
    inner = W.partitionBy(*keys, _SEG).orderBy(order)
    rows = tagged.withColumn(out, F.lag(value).over(inner))
    tails = tagged.groupBy(*keys, _SEG).agg(F.max_by(value, order).alias("_tail"))
    outer = W.partitionBy(*keys).orderBy(_SEG)
    carry = tails.select(*keys, _SEG, F.lag("_tail").over(outer).alias(_CARRY))
    if seed is not None:
        before = seed.select(*keys, F.col(value).alias("_seed"))
        carry = carry.join(before, keys, "left").select(
            *keys, _SEG, F.coalesce(_CARRY, "_seed").alias(_CARRY)
        )
    joined = _carry_join(rows, carry, keys)
    return joined.withColumn(out, F.coalesce(out, _CARRY)).drop(_SEG, _CARRY)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    exclusive: bool = False,
    width: int = SEGMENT_ROWS,
) -> DataFrame:
    """Running total of ``value`` per key in ``order``, with or without the current row."""
    last = -1 if exclusive else 0
    valued = df.withColumn("_value", value.cast("bigint"))
    tagged = cut(valued, keys, order, width)
    if tagged is None:
        whole = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, last)
        return valued.withColumn(out, F.coalesce(F.sum("_value").over(whole), F.lit(0))).drop("_value")
    inner = W.partitionBy(*keys, _SEG).orderBy(order).rowsBetween(W.unboundedPreceding, last)
    rows = tagged.withColumn(out, F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    totals = tagged.groupBy(*keys, _SEG).agg(F.sum("_value").alias("_total"))
    outer = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, _SEG, F.sum("_total").over(outer).alias(_CARRY))
    joined = _carry_join(rows, carry, keys)
    return joined.withColumn(out, F.col(out) + F.coalesce(_CARRY, F.lit(0))).drop(
        _SEG, _CARRY, "_value"
    )
