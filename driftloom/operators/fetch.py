"""Late materialisation: whole rows for the few ids that numbers alone have chosen.

Aggregates and windows run over keys and numbers; the rows with texts are fetched by id at the end. Few ids are
broadcast by Spark's own size check, so texts are not shuffled at all. Many are told to the scan first by a
Bloom filter of bounded size, four bits for an id in one word of 64, words in pages; rows that it rules out never
reach an exchange, and an exact join decides on the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.sources.tables import written

#: Up to so many ids the join alone does; Spark broadcasts them.
FEW = 100_000
#: Bits of the filter for each id, at least and at most in all (64 MB).
BITS_PER_ID, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 29
_PAGE_WORDS = 512


def _word_and_bits(key: list[str], words: int) -> tuple[Column, Column]:
    """The word of an id, and its bits there."""
    names = ", ".join(f"`{c}`" for c in key)
    bits = F.expr(" | ".join(f"shiftleft(1L, (shiftright(hash({names}), {6 * i})) & 63)" for i in range(4)))
    return F.pmod(F.xxhash64(*key), F.lit(words)), bits


def bloom_pages(ids: DataFrame, key: list[str], n: int) -> tuple[DataFrame, int]:
    """(page, words) of a Bloom filter for ``n`` ids, and its number of words. Words are combined before they move."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ID * max(n, 1) - 1).bit_length())) // 64
    word, bits = _word_and_bits(key, size)
    words = ids.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    entry = F.struct((F.col("_word") % _PAGE_WORDS).cast("int").alias("i"), F.col("_bits").alias("b"))
    pages = words.groupBy(F.floor(F.col("_word") / _PAGE_WORDS).alias("_page")).agg(F.collect_list(entry).alias("_some"))
    # Words that no id has are added and all are sorted; looking each word up in the page would take its square.
    absent = F.array_except(F.sequence(F.lit(0), F.lit(_PAGE_WORDS - 1)), F.transform("_some", lambda e: e["i"]))
    empty = F.transform(absent, lambda i: F.struct(i.alias("i"), F.lit(0).cast("bigint").alias("b")))
    whole = F.transform(F.sort_array(F.concat("_some", empty)), lambda e: e["b"])
    return pages.select("_page", whole.alias("_words")), size


def _marked(rows: DataFrame, pages: DataFrame, size: int, key: list[str]) -> DataFrame:
    """The rows with ``_may``: whether the filter has their id. The pages are broadcast; no row moves."""
    word, bits = _word_and_bits(key, size)
    placed = rows.withColumns({"_word": word, "_bits": bits}).withColumn("_page", F.floor(F.col("_word") / _PAGE_WORDS))
    there = F.get("_words", (F.col("_word") % _PAGE_WORDS).cast("int"))
    hit = F.coalesce(there.bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))
    return placed.join(F.broadcast(pages), "_page", "left").withColumn("_may", hit).drop("_page", "_words", "_word", "_bits")


def parted(rows: DataFrame, ids: DataFrame, key: list[str], few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id may be among ``ids`` (a written table), and those where it cannot be; None if that is not worth it."""
    n = ids.count()
    if n <= few:
        return rows, None
    pages, size = bloom_pages(ids, key, n)
    marked = _marked(rows, written(pages, "bloom"), size, key)
    return marked.filter("_may").drop("_may"), marked.filter("not _may").drop("_may")


def _same(rows: DataFrame, ids: DataFrame, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [rows[c].eqNullSafe(ids[f"_{c}"]) for c in key])


def fetch(rows: DataFrame, ids: DataFrame, key: list[str], few: int = FEW) -> DataFrame:
    """The rows whose id is among ``ids`` (unique there), with the other columns of ``ids``. Ids are written first; nulls are equal."""
    ids = written(ids, "chosen-ids")
    may, _ = parted(rows, ids, key, few)
    more = [c for c in ids.columns if c not in key]
    named = ids.select(*[F.col(c).alias(f"_{c}") for c in key], *more)
    return may.join(named, _same(may, named, key)).select(*[may[c] for c in rows.columns], *more)


def latest_ids(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Keys and order columns of the newest row per key: one aggregation of numbers for each order column."""
    narrow = df.select(*keys, *order)
    top = narrow.groupBy(*keys).agg(F.max(order[0]).alias(order[0]))
    for n in range(1, len(order)):
        done = [*keys, *order[:n]]
        top = top.withColumnsRenamed({c: f"_{c}" for c in done})
        top = narrow.join(top, _same(narrow, top, done)).groupBy(*done).agg(F.max(order[n]).alias(order[n]))
    return top
