"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is rotated at random, several times, and only the signs of its components are kept, with its length
and the inner products of the signs with its own direction. From these an inner product with any query is
estimated with a known error; what may be among the nearest by the error's bound is worked out exactly in
double precision.

Vectors that are null, zero, of an unusual length, or hold null or non-finite components, and rows without an
id, are neither queries nor candidates. Repeated rows are candidates each for itself. An empty table has no
neighbours. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import written
from driftloom.llm.vectors import blocked, dots, usable

#: Standard errors of the bound; the estimate is off by more for one pair in some thousands.
ERRORS = 3.5
#: Rotations, and so bits for each component; the error falls as their square root.
CODES = 4
#: Vectors of a block, queries of a chunk, queries whose estimates are in memory at once.
BLOCK, CHUNK, STRIP = 16384, 1024, 64
#: Exact products worked out at once.
RERANK = 1 << 18
SEED = 4242


def turns(d: int) -> np.ndarray:
    """Random rotations side by side (d x CODES d), the same in every task."""
    rng = np.random.default_rng(SEED)
    made = []
    for _ in range(CODES):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, axis=1)


def encode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and for each rotation the inner product of the signs' direction with the vector's own."""
    n, d = data.shape
    length = np.sqrt(dots(data, data))
    turned = (data / length[:, None]) @ turns(d)
    return np.packbits(turned >= 0, axis=1), length, np.abs(turned).reshape(n, CODES, d).sum(axis=2) / np.sqrt(d)


def index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Written blocks of all vectors: ids, codes, scalars, and the vectors themselves for the exact products."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more: list[list[bytes]] = [[], [], []]
            for ids, data in zip(batch.column("ids"), batch.column("data"), strict=True):
                for column, value in zip(more, encode(np.frombuffer(data.as_py()).reshape(len(ids.as_py()) // 8, -1)), strict=True):
                    column.append(value.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], [*batch.schema.names, "codes", "lengths", "fits"])

    schema = "block bigint, ids binary, data binary, codes binary, lengths binary, fits binary"
    return written(blocked(rows, block).mapInArrow(each, schema), "vector-index")


def nearest_in_block(block: dict, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query, neighbour, product) of the nearest ``k`` in a block, for each query."""
    own = np.frombuffer(block["ids"], np.int64)
    data = np.frombuffer(block["data"]).reshape(len(own), -1)
    d = data.shape[1]
    signs = np.unpackbits(np.frombuffer(block["codes"], np.uint8).reshape(len(own), -1), axis=1, count=CODES * d).astype(np.float32) * 2 - 1
    length, fit = np.frombuffer(block["lengths"]), np.frombuffer(block["fits"]).reshape(len(own), CODES)
    # Each rotation gives an estimate of its own; they are averaged, and so are their independent errors.
    signs *= np.repeat(length[:, None] / (fit * np.sqrt(d) * CODES), d, axis=1).astype(np.float32)
    error = (length * ERRORS * np.sqrt(np.maximum(1 / fit**2 - 1, 0).sum(axis=1)) / CODES / np.sqrt(max(d - 1, 1))).astype(np.float32)
    turned = (queries @ turns(d)).astype(np.float32)
    lengths = np.sqrt(dots(queries, queries))
    out = []
    for at in range(0, len(ids), STRIP):
        strip = slice(at, min(at + STRIP, len(ids)))
        estimate = turned[strip] @ signs.T
        estimate[ids[strip, None] == own[None, :]] = -np.inf
        first = min(3 * k, len(own))
        top = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
        rows = np.repeat(np.arange(len(top)), first)
        exact = dots(queries[at + rows], data[top.ravel()]).reshape(top.shape)
        exact[np.isneginf(np.take_along_axis(estimate, top, axis=1))] = -np.inf
        worst = np.sort(exact, axis=1)[:, -min(k, first)]
        may = estimate + error[None, :] * lengths[strip, None].astype(np.float32) >= (worst - 1e-6 * np.abs(worst))[:, None]
        may &= ~np.isneginf(estimate)
        np.put_along_axis(may, top, ~np.isneginf(exact), axis=1)
        q, v = np.nonzero(may)
        score = np.concatenate([dots(queries[at + q[s : s + RERANK]], data[v[s : s + RERANK]]) for s in range(0, len(q), RERANK)] or [np.zeros(0)])
        order = np.lexsort((own[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        starts = np.searchsorted(q, np.arange(len(top)))
        best = np.arange(len(q)) - starts[q] < k
        out.append((ids[at + q[best]], own[v[best]], score[best]))
    return out


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` nearest of each query, ties to the smaller id.

    ``is_query`` is a condition on ``id``. Queries meet the index in chunks: a task has one chunk and the
    blocks of one lane, about one. Every lane sends on no more than ``k`` of each query.
    """
    rows = usable(vectors, id_col, vector_col)
    blocks = index(rows, block)
    asked = written(blocked(rows.filter(is_query), chunk).select("block", "ids", "data"), "query-chunks")
    lanes, chunks = max(1, blocks.count()), max(1, asked.count())
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes))
    left = blocks.withColumn("lane", lane).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    right = right.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))))

    def meet(data: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        for q in queries.to_pylist():
            ids = np.frombuffer(q["ids"], np.int64)
            own = np.frombuffer(q["data"]).reshape(len(ids), -1)
            for b in data.to_pylist():
                found += nearest_in_block(b, ids, own, k)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    found = left.groupBy("lane", "chunk").cogroup(right.groupBy("lane", "chunk")).applyInArrow(meet, "query_id bigint, id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
