"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.tables import owned_path, written

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Items in a block of ``scan``: work is linear in the list but for this factor.
SCAN_BLOCK = 256
#: Rows and bytes that :func:`small_batches` lets Python have at once.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

__all__ = ["WORD", "dropped_shuffles", "giving_back", "let", "scan", "small_batches", "table", "words", "written", "written_in_buckets"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands rows to Python in small Arrow batches, so a task holds few of them on either side."""
    wanted = {"maxRecordsPerBatch": str(BATCH_ROWS), "maxBytesPerBatch": str(BATCH_BYTES)}
    limits = {f"spark.sql.execution.arrow.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files once it has ended; else they stay until the driver collects its garbage.

    For queries whose results are stored at once: running one of their plans again would move its rows again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def give_back() -> None:
    """Returns the room of freed objects to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on a task's batches, after which the worker keeps no room of it.

    Spark uses its Python workers again, in turn; what each keeps of its largest task adds up beside later stages.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return whole


def written_in_buckets(df: DataFrame, key: str, label: str) -> DataFrame:
    """The same rows, written by the hash of a key, as many buckets as a shuffle has partitions.

    What groups or joins them by the key later need not move them again. The name that the writer needs is
    taken back at once; the files stay in the shared folder.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", owned_path(spark, label)).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"drop table {name}")
    return rows


def words(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each item of a list, ``op`` over the items before it, ``zero`` for the first.

    The list is taken in blocks, because a growing list inside ``aggregate`` is copied at every step.
    """

    def steps(items: Column, start: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out")),
            lambda s, v: F.struct(op(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )

    def block(b: Column) -> Column:
        return F.slice(values, b * SCAN_BLOCK + 1, SCAN_BLOCK)

    numbers = F.sequence(F.lit(0), ((F.size(values) - 1) / SCAN_BLOCK).cast("int"))
    totals = F.transform(numbers, lambda b: F.aggregate(block(b), zero, op))
    by_block = let(
        steps(totals, zero),
        lambda starts: F.flatten(F.transform(numbers, lambda b: steps(block(b), F.element_at(starts, b + 1)))),
    )
    return F.when(F.size(values) <= SCAN_BLOCK, steps(values, zero)).otherwise(by_block)
