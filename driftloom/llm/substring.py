"""Substring dedup: words in windows that an earlier document also has are removed.

A window is a run of consecutive words of one document; a word goes if a window that covers it, word for
word, also starts in a document with a smaller id. Consecutive windows that share a minimiser (the least
hash of the short runs in a window) travel as one packed string to the minimiser's bucket, and there
sorting brings equal windows together. Only strings whose minimiser occurs in several documents travel.

A null text has no words; a text shorter than a window keeps all of them. Rows of one doc_id are never
earlier than each other; repeated rows have equal results; a row without doc_id is no earlier document
and loses nothing. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import words, written
from driftloom.llm.minhash import lists_of, mixed

WINDOW = 50
#: Words of a short run, of which a window's minimiser is the least.
RUN = 8
#: Minimisers with more strings than this go another way, by single windows, which are combined before they move.
BUCKET_ROWS = 10_000
#: Strings sorted at once, at least; whole buckets are added up to it.
SORT_ROWS = 20_000

_PRIMES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def run_hashes(h: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every run of ``length`` numbers."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    up = np.full(len(h), factor, np.uint64)
    down = np.full(len(h), pow(factor, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return (sums[length:] - sums[:-length]) * down[: len(h) - length + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def starts_in_documents(ends: np.ndarray, length: int) -> np.ndarray:
    """Places, in lists put end to end, at which a run of ``length`` starts and stays within its list."""
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    return np.repeat(ends[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def super_runs(flat: np.ndarray, ends: np.ndarray, window: int, run: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of consecutive windows of a document with one minimiser: (minimiser, first place, windows)."""
    places = starts_in_documents(ends, window)
    if not len(places):
        return np.zeros(0, np.uint64), places, places
    least = sliding_min(mixed(run_hashes(flat, run, _PRIMES[0])), window - run + 1)[places]
    fresh = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (places[1:] != places[:-1] + 1)]))
    return least[fresh], places[fresh], np.diff(np.append(fresh, len(places)))


def repeated(flat: np.ndarray, ends: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of strings (put end to end) that a string of a smaller document also has: (string, place in it)."""
    places = starts_in_documents(ends, window)
    string = np.searchsorted(ends, places, side="right") - 1
    one, two = (run_hashes(flat, window, p)[places] for p in _PRIMES)
    owner = doc[string]
    order = np.lexsort((owner, two, one))
    fresh = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.zeros(0, bool)
    first = owner[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(order) else owner
    hit = np.sort(order[owner[order] > first])
    return string[hit], places[hit] - ends[string[hit]]


def spans(string: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a string as spans of words: (string, from, to)."""
    if not len(string):
        return string, place, place
    fresh = np.concatenate([[True], (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(string) - 1)
    return string[fresh], place[fresh], place[last] + window


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (digest of the kept words, joined by one space)."""
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    source = source.withColumn("print", F.xxhash64("text"))
    split = source.select("doc", "print", words(F.col("text")).alias("words")).select(
        "doc", "print", F.size("words").cast("bigint").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("whole"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("hashes")
            ends, flat = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values).view(np.uint64)
            flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
            least, place, count = super_runs(flat, ends, window, run)
            bounds = np.searchsorted(place, ends)
            document = np.searchsorted(ends, place, side="right") - 1
            lists = [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, t))
                for v, t in ((least.view(np.int64), pa.int64()), (place - ends[document], pa.int32()), (count, pa.int32()))
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", "print", "n_words", "whole")), *lists],
                ["doc", "print", "n_words", "whole", "least", "start", "count"],
            )

    schema = "doc bigint, print bigint, n_words bigint, whole string, least array<bigint>, start array<int>, count array<int>"
    runs = written(split.mapInArrow(cut, schema), "super-runs")

    each = runs.filter(F.col("doc").isNotNull()).select("doc", "print", F.explode(F.arrays_zip("least", "start", "count")).alias("r"))
    each = each.select("doc", "print", F.col("r.least").alias("least"), F.col("r.start").alias("start"), F.col("r.count").alias("count"))
    known = each.groupBy("least").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("rows"))
    shared = known.filter("low < high").select("least", (F.col("rows") > bucket_rows).alias("hot"))
    picks = each.join(shared, "least").groupBy("doc", "print").agg(
        F.collect_list(F.struct("start", "count", "least", "hot")).alias("picks")
    )
    touched = written(source.join(picks, ["doc", "print"]).dropDuplicates(["doc", "print"]), "touched")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["text"].encode().split()
                out = [p for p in row["picks"] if not p["hot"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["least"] for p in out], pa.int64()), pa.array([row["doc"]] * len(out), pa.int64()),
                        pa.array([row["print"]] * len(out), pa.int64()), pa.array([p["start"] for p in out], pa.int32()),
                        pa.array([b" ".join(parts[p["start"] : p["start"] + p["count"] + window - 1]).decode() for p in out], pa.string()),
                    ],
                    ["least", "doc", "print", "start", "packed"],
                )

    packed = touched.mapInArrow(strings, "least bigint, doc bigint, print bigint, start int, packed string")
    bucketed = packed.repartition("least").sortWithinPartitions("least")
    bucketed = bucketed.select(
        "least", "doc", "print", "start", F.transform(F.split("packed", " "), lambda w: F.xxhash64(w)).alias("hashes")
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            hashes = table.column("hashes").chunk(0)
            ends = np.asarray(hashes.offsets).astype(np.int64)
            flat = np.asarray(hashes.values).view(np.uint64)[ends[0] : ends[-1]]
            string, place = repeated(flat, ends - ends[0], table.column("doc").to_numpy(), window)
            string, low, high = spans(string, place, window)
            start = table.column("start").to_numpy()[string]
            columns = [table.column(c).to_numpy()[string] for c in ("doc", "print")]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(start + low, pa.int32()), pa.array(start + high, pa.int32())],
                ["doc", "print", "low", "high"],
            )

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= SORT_ROWS:
                # The last bucket may go on in the next batch.
                table = pa.Table.from_batches(held)
                least = table.column("least").to_numpy()
                whole = int(np.flatnonzero(np.append(True, least[1:] != least[:-1]))[-1])
                if whole:
                    yield done(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                rows = sum(map(len, held))
        if rows:
            yield done(pa.Table.from_batches(held))

    found = bucketed.mapInArrow(sort, "doc bigint, print bigint, low int, high int")

    # Very frequent minimisers: single windows, whose least document is worked out before they meet.
    hot = touched.filter(F.exists("picks", lambda p: p["hot"]))
    hot = hot.select("doc", "print", "picks", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = batch.select(["doc", "print", "picks"]).to_pylist()
            for row, h in zip(meta, lists_of(batch, "hashes"), strict=True):
                place = np.concatenate([np.arange(p["start"], p["start"] + p["count"]) for p in row["picks"] if p["hot"]])
                one, two = (run_hashes(h, window, p)[place].view(np.int64) for p in _PRIMES)
                same = [pa.array(np.full(len(place), row[c]), pa.int64()) for c in ("doc", "print")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(one), pa.array(two), pa.array(place, pa.int32())], ["doc", "print", "one", "two", "low"])

    single = hot.mapInArrow(windows, "doc bigint, print bigint, one bigint, two bigint, low int")
    earliest = single.groupBy("one", "two").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    late = single.join(earliest.select("one", "two", "first"), ["one", "two"]).filter("doc > first")
    found = found.unionByName(late.select("doc", "print", "low", (F.col("low") + window).alias("high")))

    marks = found.groupBy("doc", "print").agg(F.collect_list(F.struct("low", "high")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row["text"].encode().split()
                steps = np.zeros(len(parts) + 1, np.int64)
                np.add.at(steps, [g["low"] for g in row["gone"]], 1)
                np.add.at(steps, [g["high"] for g in row["gone"]], -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = b" ".join([parts[i] for i in np.flatnonzero(~gone).tolist()])
                out.append({"doc": row["doc"], "print": row["print"], "n_removed": int(gone.sum()), "kept": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    texts = touched.select("doc", "print", "text").join(marks, ["doc", "print"])
    changed = texts.mapInArrow(keep, "doc bigint, print bigint, n_removed bigint, kept string")
    return runs.select("doc", "print", "n_words", "whole").join(changed, ["doc", "print"], "left").select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
