"""Near-duplicate documents by SetSketch registers: band, estimate by likelihood, verify on full sets.

Shingles are runs of words, lower-cased in A-Z; a text with fewer words is one shingle; a null text or one
without words has none and is linked with nothing. Equal sets are one class from the start. Rows that share
a doc_id count as one document; a row without doc_id is no document and gets no component. Only the id and
the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import giving_back, small_batches, words, written
from driftloom.llm.graph import components

#: Registers are ROWS lines of TABLE; each run of ROWS and, for each of STEPS, each column that moves so far
#: along from line to line is a band. Two bands have one register in common at most. README: what they miss.
TABLE, ROWS = 30, 9
STEPS = (0, 11, 19)
REGISTERS = TABLE * ROWS
#: Base of the registers' spacing, and the largest value, which is that of sets of 10^10 shingles.
BASE, MOST = 1.1, 255
#: Pairs whose estimate is so many standard errors below the threshold are not verified (1 in a million or less).
ERRORS = 5
#: Shingles hashed at once; members of a bucket that meet at once.
CHUNK, TILE = 4096, 256
#: Sets whose band keys a task makes.
HEADS = 8192
#: Members of a bucket that are joined with each other; larger buckets are compared in tiles.
SMALL = 32

_rng = np.random.default_rng(20240101)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit numbers."""
    if not len(word_hashes):
        return np.zeros(0, np.uint64)
    size = min(size, len(word_hashes))
    out = np.full(len(word_hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : len(word_hashes) - size + 1 + i])
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Of each register's minimum over the set, which exponential step it lies in."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        values = shingles[at : at + CHUNK, None] * _MULTIPLY
        values += _ADD
        np.minimum(least, values.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2e-16))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 1, 0, MOST).astype(np.uint8)


def similarity_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that makes the counts of larger, smaller and equal registers most likely, set sizes known."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        same = np.maximum(1 - up - down, tiny)
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(same)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(one) > likelihood(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def hashed_words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(words(lower), lambda w: F.xxhash64(w))


def lists_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    ends, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, least: int) -> DataFrame:
    """node, n (set size), same (equal for equal sets), registers (none for sets smaller than ``least``), print (the text's hash)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for hashes in lists_of(batch, "hashes"):
                own = shingle_set(hashes, size)
                out[0].append(len(own))
                out[1].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                out[2].append(registers(own).tobytes() if len(own) >= least else None)
            made = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *made, batch.column("print")], ["node", "n", "same", "registers", "print"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("node"), hashed_words(F.col(f"`{text_col}`")).alias("hashes"), F.xxhash64(f"`{text_col}`").alias("print"))
    return rows.mapInArrow(giving_back(each), "node bigint, n bigint, same binary, registers binary, print bigint")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The whole sets of some documents, written."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(h, size).tobytes() for h in lists_of(batch, "hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("node"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(nodes, "node", "left_semi").select("node", hashed_words(F.col("text")).alias("hashes"))
    return written(rows.mapInArrow(giving_back(each), "node bigint, shingles binary"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) for which 100 x intersection >= percent x union."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                keep.append(similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two)), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "one"), ("b", "two")))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(each, "a bigint, b bigint")


def least_estimate(percent: int) -> float:
    """The estimate from which pairs are verified, in buckets of any size."""
    share = percent / 100
    return float(share - ERRORS * np.sqrt(share * (1 - share) / REGISTERS))


def likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that can be similar by their sizes and their registers' likelihood, with the estimate."""
    least = least_estimate(percent)

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (a, b))
        return pd.Series(similarity_estimate(x, y, n_a.to_numpy(float), n_b.to_numpy(float)))

    left, right = (heads.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}")) for k in "ab")
    sized = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()
    scored = sized.join(left, "a").join(right, "b").select("a", "b", estimate("r_a", "r_b", "n_a", "n_b").alias("estimate"))
    return written(scored.filter(F.col("estimate") >= least), "likely-pairs")


def band_keys(registers: Column) -> Column:
    """Keys of all bands, each with the band's number in it: the runs of registers, then the columns of each step."""
    numbers = F.sequence(F.lit(0), F.lit(TABLE - 1))
    part = registers.substr

    def columns(at: int, step: int) -> Column:
        places = lambda i: [(i + step * k) % TABLE + (k * TABLE + 1) for k in range(ROWS)]
        return F.transform(numbers, lambda i: F.xxhash64(i + at * TABLE, F.concat(*[part(p, F.lit(1)) for p in places(i)])))

    runs = F.transform(numbers, lambda i: F.xxhash64(i, part(i * ROWS + 1, F.lit(ROWS))))
    return F.concat(runs, *[columns(at, step) for at, step in enumerate(STEPS, 1)])


_LINES = [np.concatenate([k * TABLE + (np.arange(TABLE) + step * k) % TABLE for k in range(ROWS)]) for step in STEPS]


def share_a_band(equal: np.ndarray) -> np.ndarray:
    """From which registers of pairs are equal, whether there is a band that they share."""
    bands = [equal.reshape(len(equal), TABLE, ROWS).all(axis=2)]
    bands += [equal[:, line].reshape(len(equal), ROWS, TABLE).all(axis=1) for line in _LINES]
    return np.concatenate(bands, axis=1).any(axis=1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 x intersection >= percent x union, of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def compare_tiles(x: pa.Table, y: pa.Table, same: bool, percent: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between two tiles of a group that join different components, of pairs that share a band.

    Likely pairs are verified on full sets, the likeliest first; what earlier links have joined is not looked at again.
    """
    node, n, component = ([t.column(c).to_numpy() for t in (x, y)] for c in ("node", "n", "component"))
    regs = [np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint8).reshape(len(t), -1) for t in (x, y)]
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(node[0])):
        low, high = np.minimum(n[0][i], n[1]), np.maximum(n[0][i], n[1])
        may = (component[0][i] != component[1]) & (node[0][i] != node[1]) & (100 * low >= percent * high)
        if same:
            may[: i + 1] = False
        j = np.flatnonzero(may)
        if not len(j):
            continue
        # Far too few equal registers are dropped before anything else is worked out.
        equal = regs[0][i] == regs[1][j]
        enough = np.count_nonzero(equal, axis=1) >= least * REGISTERS
        j, equal = j[enough], equal[enough]
        if len(j):
            j = j[share_a_band(equal)]
            one.append(np.full(len(j), i))
            two.append(j)
    i, j = np.concatenate(one), np.concatenate(two)
    estimate = np.zeros(len(i))
    for at in range(0, len(i), CHUNK):
        x_, y_ = i[at : at + CHUNK], j[at : at + CHUNK]
        estimate[at : at + CHUNK] = similarity_estimate(regs[0][x_], regs[1][y_], n[0][x_].astype(float), n[1][y_].astype(float))
    sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("shingles")] for t in (x, y)]
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    links = []
    for k in np.argsort(-estimate, kind="stable").tolist():
        if estimate[k] < least:
            break
        p, q = root(int(component[0][i[k]])), root(int(component[1][j[k]]))
        if p != q and similar(sets[0][i[k]], sets[1][j[k]], percent):
            joined[max(p, q)] = min(p, q)
            links.append((int(node[0][i[k]]), int(node[1][j[k]])))
    a, b = (np.array([link[side] for link in links], np.int64) for side in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def in_tiles(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of groups (key) with tile and other, the two tiles that meet: first sides, second sides.

    A component with ``TILE`` members or more of a group has tiles of its own, numbered first, which do not meet
    each other; the members of smaller components share tiles, which meet all tiles of the group and themselves.
    """
    sizes = written(apart.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members")), "tile-sizes")
    pieces = F.ceil(F.col("members") / TILE).cast("int")
    before = Window.partitionBy("key").orderBy("component")
    large = sizes.filter(F.col("members") >= TILE).select("key", "component", pieces.alias("pieces"))
    large = large.withColumn("start", (F.sum("pieces").over(before) - F.col("pieces")).cast("int"))
    own = F.when(F.col("members") >= TILE, pieces).otherwise(0)
    rest = F.ceil(F.sum(F.when(F.col("members") < TILE, F.col("members")).otherwise(0)) / TILE).cast("int")
    counts = sizes.groupBy("key").agg(F.sum(own).cast("int").alias("own"), rest.alias("shared"))
    counts = counts.withColumn("tiles", F.col("own") + F.col("shared"))
    places = written(sizes.select("key", "component").join(counts, "key").join(large, ["key", "component"], "left"), "tile-places")

    alone, number = F.col("start").isNotNull(), F.xxhash64("node")
    dealt = apart.join(places, ["key", "component"]).withColumn(
        "at", F.when(alone, F.col("start") + F.pmod(number, F.col("pieces"))).otherwise(F.col("own") + F.pmod(number, F.col("shared"))).cast("int")
    )
    low = F.when(alone, F.col("start") + F.col("pieces")).otherwise(F.col("at"))
    high = F.when(alone, F.col("start") - 1).otherwise(F.col("at"))
    # What has no tile to meet falls out here.
    after = F.when(low < F.col("tiles"), F.sequence(low, F.col("tiles") - 1))
    until = F.when(high >= 0, F.sequence(F.lit(0), high))
    columns = apart.columns
    left = dealt.select(*columns, F.col("at").alias("tile"), F.explode(after).alias("other"))
    right = dealt.select(*columns, F.col("at").alias("other"), F.explode(until).alias("tile"))
    return left, right


def across(apart: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components in groups (key) of large buckets: each member once, with its registers and full set.

    A group is cut into tiles of about ``TILE`` members, and every two tiles that may hold different components
    meet in a place of their own, so a large group is no single task's work. Its pairs are looked at there, once
    however many buckets they share; only links leave.
    """
    least = least_estimate(percent)
    apart = written(apart, "apart")
    left, right = in_tiles(apart)
    columns = ["node", "n", "component", "registers", "shingles"]
    left = left.select("key", "tile", "other", *columns)
    right = right.select(F.col("key").alias("key_2"), F.col("tile").alias("tile_2"), F.col("other").alias("other_2"), *[F.col(c).alias(c) for c in columns])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        same = x.column("tile")[0].as_py() == x.column("other")[0].as_py()
        order = [("node", "ascending")]
        a, b = compare_tiles(x.sort_by(order), y.sort_by(order), same, percent, least)
        return pa.table({"a": a, "b": b})

    return left.groupBy("key", "tile", "other").cogroup(right.groupBy("key_2", "tile_2", "other_2")).applyInArrow(meet, "a bigint, b bigint")


def grouped(large: DataFrame) -> DataFrame:
    """Members (key, node, n, component) of large buckets, each document once: buckets that overlap are one group (key)."""
    first = large.groupBy("key").agg(F.min("node").alias("a"))
    groups = components(large.join(first, "key").select("a", F.col("node").alias("b")))
    once = large.select("node", "n", "component").distinct()
    return once.join(groups.select("node", F.col("component").alias("key")), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, prints: bool = False) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable), kept (whether that is the row's own); with ``prints``, print (xxhash64 of the text).

    In a bucket, every set is first compared with the bucket's smallest id; after the links so found, what lies
    in different components is compared pair by pair, so a group of copies in one component never makes all its
    pairs. The work is quadratic in the members of a bucket that are still apart.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, size, percent, prints)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, prints: bool) -> DataFrame:
    # A smaller set can only be similar to an equal one: one more shingle makes it too different.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    sketched = written(sketch(docs, id_col, text_col, size, least), "sketches")
    classes = sketched.filter(F.col("node").isNotNull() & F.col("same").isNotNull()).groupBy("same").agg(F.min("node").alias("head"))
    with_registers = sketched.filter(F.col("registers").isNotNull() & F.col("node").isNotNull())
    heads = with_registers.join(classes.withColumnRenamed("head", "node"), ["same", "node"], "left_semi")
    heads = written(heads.select("node", "n", "registers"), "sketch-heads")

    # Most keys occur once, so a task's map of keys is as large as what it explodes; that is kept small.
    spread = heads.repartition(max(1, -(-heads.count() // HEADS)), "node")
    banded = spread.select("node", "n", F.explode(band_keys(F.col("registers"))).alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    members = written(banded.join(shared.select("key", "first"), "key"), "band-members")

    sizes = heads.select(F.col("node").alias("first"), F.col("n").alias("n_a"))
    stars = members.filter("node > first").select("first", F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
    stars = stars.join(sizes, "first").withColumnRenamed("first", "a")
    candidates = likely(stars, heads, percent)
    best = candidates.groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("a"))).alias("best"))
    best = best.select((-F.col("best.a")).alias("a"), "b")

    ends = written(candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).distinct(), "ends")
    sets = full_sets(docs, ends, id_col, text_col, size)
    links = written(verified(best, sets, percent), "links")
    found = components(links)

    # What is still apart within a bucket.
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    apart = apart.filter("low < high")
    apart = apart.select("key", (F.col("members") > SMALL).alias("large"))
    apart = written(labelled.join(apart, "key").select("key", "node", "n", "component", "large"), "apart")
    one, two = (apart.filter("not large").select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "component")]) for k in "ab")
    pairs = one.join(two, "key").filter((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")))
    pairs = likely(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b"), heads, percent)
    more = written(pairs.select("a", "b").distinct(), "likely-pairs")
    large = written(grouped(apart.filter("large").drop("large")), "grouped")
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).union(large.select("node")).distinct()
    # Written, so that Spark knows its size and need not move the texts again when it is small.
    missing = written(ends.join(sets.select("node"), "node", "left_anti"), "ends")
    both_sets = sets.unionByName(full_sets(docs, missing, id_col, text_col, size)) if not missing.isEmpty() else sets
    tiled = across(large.join(heads.select("node", "registers"), "node").join(both_sets, "node"), percent)
    late = written(verified(more, both_sets, percent).unionByName(tiled), "links")
    if not late.isEmpty():
        found = components(links.unionByName(late))

    named = sketched.select("node", "n", "same", "print").join(classes, "same", "left")
    own = found.withColumnRenamed("node", "head")
    named = named.join(own, "head", "left").withColumn("component_id", F.coalesce("component", "head", "node"))
    # Several rows of one doc_id are one document.
    return named.select(
        F.col("node").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("node") == F.col("component_id"), F.lit(False)).alias("kept"), *["print"] * prints,
    )
