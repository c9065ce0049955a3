"""Hard negatives by coordinate pruning: for each anchor and positive, near rows of other labels within a score window.

Components become floor(256 x) and scores are inner products of these whole numbers. Rows of one label and number of
components are cut, longest first, into buckets, and each bucket holds the order of its rows along every coordinate.
An anchor that seeks scores of at least t wants, in a bucket of length up to l, a cosine of t / (|anchor| l); by the
triangle inequality of angles this leaves a range of values in each coordinate. The ranges of the anchor's focus
coordinates, its largest ones, are cut out of the sorted lists, the rows in all of them are candidates, and their
scores are worked out exactly. The best found so far raise t from bucket to bucket.

Rows without id or label, and vectors that are null or hold null or non-finite components take no part; an empty vector
has score 0 with others like it. Only vectors of one number of components are compared. Repeated rows are
candidates each for itself, but never for an anchor of the same id; repeated anchors are answered each for itself. An
empty table has no negatives. Scores beyond a long stop at its ends. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import written
from driftloom.llm.vectors import matrix

SCALE = 256
#: Rows of a bucket, anchors of a chunk, buckets of a lane.
BUCKET, CHUNK, LANE = 4096, 1024, 8
#: Focus coordinates of an anchor.
FOCUS = 4
#: Above this share of a bucket, one product for the whole bucket is cheaper than one for its candidates.
DENSE = 0.25
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
#: Slack of ranges worked out in double precision; angles of nearly equal directions are that inexact.
EPS = 1e-6


def pack(data: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in doubles, as the smallest kind of number that holds them."""
    most = float(np.abs(data).max()) if data.size else 0.0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, data.astype(kind).tobytes()


def unpack(kind: str, data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(data, kind).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def lengths(data: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares would overflow."""
    top = np.maximum(np.abs(data).max(axis=1, initial=0), 1.0)
    return np.sqrt(((data / top[:, None]) ** 2).sum(axis=1)) * top


def products(rows: np.ndarray, anchor: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of rows (no component beyond ``top``) with one anchor, cut to a long."""
    if top < (1 << 53) / max(np.abs(anchor).max(initial=0) * rows.shape[1], 1.0):
        return (rows @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    sums = (sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in rows)
    return np.array([min(max(s, LEAST), MOST) for s in sums], np.int64)


class Bucket:
    """Rows of one label: ids, components, lengths, and for each coordinate the order of the rows and their sorted values."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.data = unpack(row["kind"], row["data"], n)
        self.most, self.top = row["most"], float(np.abs(self.data).max(initial=0))
        d = self.data.shape[1]
        self.order = np.frombuffer(row["sorted"], "<u2").reshape(d, n)
        size = lengths(self.data)
        unit = self.data / np.where(size > 0, size, 1)[:, None]
        self.values = np.take_along_axis(unit.T, self.order.astype(np.int64), axis=1)

    def candidates(self, unit: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Places of rows whose score may be at least ``least``; None for all."""
        n = len(self.ids)
        if least <= 0:
            return None
        cosine = least / length / self.most if length and self.most else np.inf
        if cosine > 1 + EPS:
            return np.zeros(0, np.int64)
        wide = np.arccos(min(cosine, 1.0))
        hits, needed = None, 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + wide)) - EPS, np.cos(max(0.0, angle - wide)) + EPS
            a, b = np.searchsorted(self.values[f], low, "left"), np.searchsorted(self.values[f], high, "right")
            if b - a == n:
                continue
            if hits is None:
                hits = np.zeros(n, np.uint8)
            hits[self.order[f, a:b]] += 1
            needed += 1
        return None if hits is None else np.flatnonzero(hits == needed)

    def scores(self, anchor: np.ndarray, unit: np.ndarray, length: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the rows with a score of at least ``least``."""
        found = self.candidates(unit, length, least)
        if found is None or len(found) > DENSE * len(self.ids):
            places = np.arange(len(self.ids))
            score = products(self.data, anchor, self.top)
            if found is not None:
                places, score = found, score[found]
        else:
            places, score = found, products(self.data[found], anchor, self.top)
        keep = score >= least
        return places[keep], score[keep]


def buckets(rows: DataFrame, size: int) -> DataFrame:
    """A written table of buckets: number of components, label, greatest length, ids, components and sorted coordinate lists."""
    schema = pa.schema([
        ("bucket", pa.int64()), ("d", pa.int32()), ("label", pa.int32()), ("most", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()),
        ("kind", pa.string()), ("data", pa.binary()), ("sorted", pa.binary()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        of = None

        def bucket() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            data = _components(table, of[0])
            size = lengths(data)
            unit = data / np.where(size > 0, size, 1)[:, None]
            order = np.argsort(unit.T, axis=1, kind="stable").astype("<u2")
            kind, packed = pack(data)
            row = [number, *of, float(size.max()), len(data), table.column("id").to_numpy().astype("<i8").tobytes(), kind, packed, order.tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            d, label = batch.column("d").to_numpy(), batch.column("label").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(label) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    kind = (int(d[a]), int(label[a]))
                    if held and (kind != of or sum(map(len, held)) >= size):
                        yield bucket()
                        held = []
                    of = kind
                    end = min(b, a + size - sum(map(len, held)))
                    held.append(batch.slice(a, end - a))
                    a = end
        if held:
            yield bucket()

    made = "bucket bigint, d int, label int, most double, n bigint, ids binary, kind string, data binary, sorted binary"
    return written(rows.mapInArrow(each, made), "coordinate-lists")


def _components(table: pa.Table, d: int) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return matrix(column) if d else np.zeros((len(column), 0))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """A written table of anchors in chunks of one number of components: number, ids, labels, the labels there are, components."""
    schema = pa.schema([
        ("chunk", pa.int64()), ("d", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.binary()), ("has", pa.list_(pa.int32())),
        ("data", pa.binary()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.RecordBatch]] = {}

        def chunk(d: int) -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held.pop(d)).combine_chunks()
            labels = table.column("label").to_numpy().astype("<i4")
            row = [number, d, table.column("id").to_pylist(), labels.tobytes(), np.unique(labels), _components(table, d).astype("<f8").tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for d in np.unique(batch.column("d").to_numpy()).tolist():
                part = batch.filter(pc.equal(batch.column("d"), d))
                for a in range(0, len(part), size):
                    held.setdefault(d, []).append(part.slice(a, size))
                    if sum(map(len, held[d])) >= size:
                        yield chunk(d)
        for d in list(held):
            yield chunk(d)

    return written(rows.mapInArrow(each, "chunk bigint, d int, ids array<bigint>, labels binary, has array<int>, data binary"), "anchor-chunks")


def _meet(asked: DataFrame, lists: DataFrame, lane_buckets: int, same_label: bool, work, schema: str) -> DataFrame:
    """``work(chunk, buckets)`` for every chunk and lane of buckets that have its number of components and a fitting label.

    Lanes hold buckets of one label, longest first, so that a lane that does not fit a chunk is never sent to it; a
    chunk is copied once for each lane it meets, a lane once for each chunk.
    """
    order = W.partitionBy("d", "label").orderBy(F.desc("most"), "bucket")
    names = lists.select("bucket", "d", "label", "most").withColumn("lane", F.floor((F.row_number().over(order) - 1) / lane_buckets))
    lanes = names.select("d", "label", "lane").distinct()
    has = asked.select("chunk", "d", F.explode("has").alias("own")).distinct()
    if same_label:
        pairs = has.join(lanes.withColumnRenamed("label", "own"), ["d", "own"]).select("chunk", "d", F.col("own").alias("label"), "lane")
    else:  # a lane of the only label that a chunk has is no use to it
        single = has.groupBy("chunk", "d").agg(F.min("own").alias("low"), F.max("own").alias("high"))
        pairs = single.join(lanes, "d").filter((F.col("label") != F.col("low")) | (F.col("label") != F.col("high")))
        pairs = pairs.select("chunk", "d", "label", "lane")
    pairs = written(pairs, "chunks-and-lanes")
    left = lists.join(names.select("bucket", "lane"), "bucket").join(pairs, ["d", "label", "lane"])
    right = asked.join(pairs.select("chunk", "label", "lane"), "chunk")

    def together(data: pa.Table, own: pa.Table) -> pa.Table:
        rows = sorted(data.to_pylist(), key=lambda r: (-r["most"], r["bucket"]))
        return work(own.to_pylist()[0], rows)

    return left.groupBy("chunk", "label", "lane").cogroup(right.groupBy("chunk", "label", "lane")).applyInArrow(together, schema)


def _anchors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.array(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32)
    data = np.frombuffer(row["data"]).reshape(len(ids), row["d"])
    size = lengths(data)
    return ids, labels, data, size, data / np.where(size > 0, size, 1)[:, None]


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * len(names)
    return pa.table(dict(zip(names, columns, strict=True)))


def nearest_of_label(anchors: dict, lane: list[dict], k: int) -> pa.Table:
    """(chunk, place, id, score) of the best ``k`` rows of the anchor's label in a lane."""
    ids, labels, data, size, unit = _anchors(anchors)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
    for row in lane:
        bucket = Bucket(row)
        for i in np.flatnonzero(labels == row["label"]):
            own, score = best[i]
            least = int(score[k - 1]) if len(score) >= k else LEAST
            places, more = bucket.scores(data[i], unit[i], size[i], least)
            others = bucket.ids[places] != ids[i]
            own, score = np.concatenate([own, bucket.ids[places][others]]), np.concatenate([score, more[others]])
            first = np.lexsort((own, ~score))[:k]
            best[i] = own[first], score[first]
    found = [
        (np.full(len(own), anchors["chunk"]), np.full(len(own), i), own, score) for i, (own, score) in enumerate(best) if len(own)
    ]
    return _table(found, ["chunk", "place", "id", "score"])


def best_in_windows(anchors: dict, lane: list[dict], k: int) -> pa.Table:
    """(chunk, place, window, id, score): the first ``k`` rows of other labels in each window of each anchor, in a lane."""
    ids, labels, data, size, unit = _anchors(anchors)
    windows: list[list[dict]] = [[] for _ in ids]
    for w in anchors["windows"]:
        windows[w["place"]].append({"window": w["window"], "low": w["low"], "high": w["high"], "ids": np.zeros(0, np.int64), "scores": np.zeros(0, np.int64)})
    for row in lane:
        bucket = Bucket(row)
        for i in np.flatnonzero(labels != row["label"]):
            if not windows[i]:
                continue
            # A full window asks for more than its last row, or as much with a smaller id.
            least = min(max(w["low"], int(w["scores"][k - 1])) if len(w["scores"]) >= k else w["low"] for w in windows[i])
            places, score = bucket.scores(data[i], unit[i], size[i], least)
            own = bucket.ids[places]
            others = own != ids[i]
            own, score = own[others], score[others]
            order = np.lexsort((own, ~score))
            own, score = own[order], score[order]
            for w in windows[i]:
                a, b = np.searchsorted(~score, ~w["high"], "left"), np.searchsorted(~score, ~w["low"], "right")
                if a < b:
                    more, with_score = np.concatenate([w["ids"], own[a : min(b, a + k)]]), np.concatenate([w["scores"], score[a : min(b, a + k)]])
                    first = np.lexsort((more, ~with_score))[:k]
                    w["ids"], w["scores"] = more[first], with_score[first]
    found = [
        (np.full(len(w["ids"]), anchors["chunk"]), np.full(len(w["ids"]), i), np.full(len(w["ids"]), w["window"]), w["ids"], w["scores"])
        for i, ws in enumerate(windows) for w in ws if len(w["ids"])
    ]
    return _table(found, ["chunk", "place", "window", "id", "score"])


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bucket: int = BUCKET, chunk: int = CHUNK, lane: int = LANE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: ``negatives`` rows of other labels for each of an anchor's ``positives``.

    Their scores are between ``low`` and ``high`` hundredths of the positive's; higher ones come first, ties by the
    smaller id. ``is_anchor`` is a condition on ``id``.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # Whole numbers in doubles: what floor() gives as a long would stop at its ends.
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    rows = rows.select("id", "label", F.size("vector").alias("d"), whole.alias("vector"))
    rows = rows.withColumn("length", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = written(rows, "whole-vectors")
    n = rows.count()
    parts = max(1, -(-n // (2 * bucket)))
    ranged = rows.repartitionByRange(parts, "d", "label", F.desc("length"), "id").sortWithinPartitions("d", "label", F.desc("length"), "id")
    lists = buckets(ranged.select("id", "label", "d", "vector"), bucket)

    anchors = rows.filter(is_anchor).select("id", "label", "d", "vector")
    asked = chunks(anchors.repartitionByRange(max(1, -(-anchors.count() // chunk)), "d", "label", "id"), chunk)

    near = _meet(asked, lists, lane, True, lambda a, b: nearest_of_label(a, b, positives), "chunk bigint, place bigint, id bigint, score bigint")
    order = W.partitionBy("chunk", "place").orderBy(F.desc("score"), "id")
    near = near.withColumn("window", F.row_number().over(order)).filter(F.col("window") <= positives)
    near = written(near.select("chunk", "place", F.col("window").cast("bigint").alias("window"), "id", "score"), "positives")

    # 100 s >= low p and 100 s <= high p, for whole s; a negative p has no such s.
    hundredths = lambda part: F.col("score").cast("decimal(20)") * part / 100
    window = F.struct("place", "window", F.ceil(hundredths(low)).cast("bigint").alias("low"), F.floor(hundredths(high)).cast("bigint").alias("high"))
    wanted = near.filter("score >= 0").groupBy("chunk").agg(F.collect_list(window).alias("windows"))
    hard = _meet(
        asked.join(wanted, "chunk"), lists, lane, False, lambda a, b: best_in_windows(a, b, negatives),
        "chunk bigint, place bigint, window bigint, id bigint, score bigint",
    )
    order = W.partitionBy("chunk", "place", "window").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    hard = hard.select("chunk", "place", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("chunk", F.posexplode("ids").alias("place", "anchor_id")).withColumn("place", F.col("place").cast("bigint"))
    pairs = near.select("chunk", "place", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["chunk", "place", "window"]).join(named, ["chunk", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
