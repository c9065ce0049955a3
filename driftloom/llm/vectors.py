"""What the two vector operators share: which vectors take part, and vectors packed into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the vectors that can be compared: an id, one length, finite, and not zero.

    If lengths differ, the most frequent takes part, of equally frequent ones the larger.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (length["d"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values, dtype=np.float64)[ends[0] : ends[-1]]
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, dimension after dimension: equal vectors have equal products wherever they stand."""
    if not a.size:
        return np.zeros(len(a))
    products = a * b
    np.add.accumulate(products, axis=1, out=products)
    return products[:, -1].copy()


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, data): vectors of a task in blocks of up to ``size``, as bytes of doubles; nothing is moved."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            ids = part.column("id").to_numpy().astype("<i8").tobytes()
            data = matrix(part.column("vector").chunk(0)).astype("<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids]), pa.array([data])], ["block", "ids", "data"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                number += 1
                held = table.slice(size).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))

    return rows.select("id", "vector").mapInArrow(each, "block bigint, ids binary, data binary")
