"""Near-duplicate vectors by PCA-ordered tiled comparison, of sketches first.

Dimensions are put in order of variance. A sketch is one byte for each of the leading dimensions and one for what is
left of the length, with a known error. Sketches go into large groups along the first axis, and pairs of groups meet
unless their boxes are too far apart: within a pair rows are clustered around pivots, a cluster meets what the
triangle inequality of angles leaves of the other side, and only what the sketches connect stays together. So
sketches alone move more than a few times, and the vectors themselves go once to their rows' connected sets.

There whole vectors decide. The products of the leading dimensions are summed first; the rest of a pair can add at
most the product of what is left of both lengths (their suffix norms), so most pairs stop there. What is left is
decided in double precision on the original vectors. Sets too large for a task are cut into tiles, whose pairs meet.

Vectors that are null, zero, of an unusual length, or hold null or non-finite components link with nothing,
nor do rows without an id, which get no component. Equal vectors are one class, known by a digest of 128 bits, and
are compared once; every row counts as a vector of its own. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import dropped_shuffles, written
from driftloom.llm.graph import components
from driftloom.llm.vectors import dots, matrix
from driftloom.operators.fetch import fetch
from driftloom.sources.tables import owned_tables

TILE = 4096
#: Shares of the dimensions after which pairs are dropped.
STOPS = (0.25, 0.5)
#: Rows of a tile whose products are in memory at once.
STRIP = 512
#: More survivors than this share of a strip are worked out as one product of matrices.
DENSE = 0.05
#: Leading dimensions of a tile's box.
BOX = 8
#: Leading dimensions of a sketch.
KEPT = 64
#: Sketches of a group at most; groups at least, where there are tiles for so many; sketches of a row of its table.
GROUP, LANES, PIECE = 1 << 20, 8, 1 << 16
#: Sketches of a group that are numbers, not bytes, at once.
SLICE = 1 << 17
#: Rows for each pivot, and of one that are compared at once; dimensions of a sketch whose products are made first; products in memory at once.
LEAF, ROWS, FIRST, PRODUCTS = 256, 128, 24, 1 << 19
#: Pairs that are joined at once.
JOINED = 1 << 15
#: Tiles, and bytes of vectors, that one task may hold of a connected set.
TILES, ROOM = 8, 16 << 20
#: Rows of small connected sets that are compared at once.
UNIT = 256
#: Allowance for rounding while products are in single precision, and in double precision.
SINGLE, DOUBLE = 1e-4, 1e-9


def comparable(batch: pa.RecordBatch, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (id, vector) can be compared: an id, finite, not zero, of length ``d`` if one is given; and the lengths."""
    vector = batch.column("vector")
    size = np.asarray(pc.fill_null(pc.list_value_length(vector), 0)).astype(np.int64)
    values = vector.flatten().to_numpy(zero_copy_only=False)  # null components are NaN
    ends = np.cumsum(size)
    within = lambda what: (total := np.append(0, np.cumsum(what)))[ends] - total[ends - size]
    good = np.asarray(batch.column("id").is_valid()) & (size > 0) & (within(~np.isfinite(values)) == 0) & (within(values != 0) > 0)
    return good if d is None else good & (size == d), size


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of vectors that can be compared, of equally frequent ones the larger; 0 without such."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, size = comparable(batch)
            d, n = np.unique(size[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n.astype(np.int64))], ["d", "n"])

    found = rows.mapInArrow(lengths, "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Principal directions of the unit vectors, by falling variance: sums of products by task, added up by Spark."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column("vector").filter(pa.array(comparable(batch, d)[0])))
            if len(m):
                m = m / np.sqrt(dots(m, m))[:, None]
                total += m.T @ m
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    sums = rows.mapInArrow(moments, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))
    found = np.array([r["v"] for r in sums.orderBy("i").collect()])
    return np.linalg.eigh(found.reshape(d, d))[1][:, ::-1].copy()


def rotated(data: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (data / np.sqrt(dots(data, data))[:, None]) @ axes


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) whose cosine is at least ``least``, strip by strip."""
    d = a.shape[1]
    stops = [max(1, int(d * s)) for s in STOPS] + [d]
    ra, rb = rotated(a, axes), rotated(b, axes)
    fa, fb = ra.astype(np.float32), rb.astype(np.float32)
    left = [[np.sqrt(np.maximum(1 - (r[:, :s] ** 2).sum(axis=1), 0)).astype(np.float32) for s in stops] for r in (ra, rb)]
    length_a, length_b = np.sqrt(dots(a, a)), np.sqrt(dots(b, b))
    for at in range(0, len(a), STRIP):
        strip = slice(at, at + STRIP)
        bound = fa[strip, : stops[0]] @ fb[:, : stops[0]].T
        bound += left[0][0][strip, None] * left[1][0][None, :]
        i, j = np.nonzero(bound >= least - SINGLE)
        if len(i) > DENSE * bound.size:
            cosine = ra[strip] @ rb.T
            i, j = np.nonzero(cosine >= least - DOUBLE)
            unsure = cosine[i, j] < least + DOUBLE
            i += at
        else:
            i += at
            product = (fa[i, : stops[0]] * fb[j, : stops[0]]).sum(axis=1)
            for k in range(1, len(stops)):
                part = slice(stops[k - 1], stops[k])
                product += (fa[i, part] * fb[j, part]).sum(axis=1)
                go_on = product + left[0][k][i] * left[1][k][j] >= least - SINGLE
                i, j, product = i[go_on], j[go_on], product[go_on]
            unsure = np.ones(len(i), bool)
        for start in range(0, len(i), 1 << 18):
            some = np.arange(start, min(start + (1 << 18), len(i)))
            doubt = some[unsure[some]]
            x, y = i[doubt], j[doubt]
            right = np.ones(len(some), bool)
            right[unsure[some]] = dots(a[x], b[y]) / (length_a[x] * length_b[y]) >= least
            yield i[some[right]], j[some[right]]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1, the least that links (i, j) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bytes_of(flat: np.ndarray) -> pa.Array:
    """Each row of a table of numbers as bytes."""
    width = flat.shape[1] * flat.itemsize
    ends = np.arange(len(flat) + 1, dtype=np.int64) * width
    made = pa.Array.from_buffers(pa.large_binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
    return made.cast(pa.binary())


def numbers(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The other way round: bytes of rows of one width as a table of numbers."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def sketch(data: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading components and the length of the rest in bytes, to a scale of the row's own, and how far they are off.

    The angle between two vectors is at least the one between their leading components with the rest's length; a row of
    bytes is off from that by an angle whose sine is the second result.
    """
    r = rotated(data, axes)
    short = r[:, :KEPT]
    if r.shape[1] > KEPT:
        short = np.column_stack([short, np.sqrt((r[:, KEPT:] ** 2).sum(axis=1))])
    step = np.abs(short).max(axis=1, keepdims=True) / 127
    codes = np.rint(short / step)
    return codes.astype(np.int8), np.sqrt(((short - codes * step) ** 2).sum(axis=1)) + DOUBLE


def single(rows: DataFrame) -> bool:
    """Whether the vectors are of single precision."""
    return isinstance(getattr(rows.schema["vector"].dataType, "elementType", None), T.FloatType)


def keyed(rows: DataFrame, d: int, axes: np.ndarray | None = None, data: bool = False) -> DataFrame:
    """id and ``key``, the digest of the row's vector, null if it can't be compared.

    With axes, only rows that can be, and their sketches; with data, their vectors as bytes of their own kind of number.
    """
    whole = axes is None and not data
    kind = np.float32 if single(rows) else np.float64
    schema = "id bigint, key binary" + (", lead double, code binary, off double" if axes is not None else ", data binary" if data else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = comparable(batch, d)[0]
            if not whole:
                batch, there = batch.filter(pa.array(there)), np.ones(int(there.sum()), bool)
            m = matrix(batch.column("vector").filter(pa.array(there))) + 0.0  # no negative zero
            own = bytes_of(m.astype(kind))
            keys = np.full(len(batch), None, object)
            keys[there] = [blake2b(x, digest_size=16).digest() for x in own.to_pylist()]
            columns = [batch.column("id"), pa.array(keys, pa.binary())]
            if axes is not None:
                code, off = sketch(m, axes) if len(m) else (np.ones((0, 1), np.int8), np.zeros(0))
                columns += [pa.array(units(code)[:, 0].astype(np.float64)), bytes_of(code), pa.array(off)]
            elif data:
                columns.append(own)
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(each, schema)


def units(code: np.ndarray) -> np.ndarray:
    """Sketches as vectors of length 1."""
    u = code.astype(np.float32)
    return u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]


def groups(classes: DataFrame, n: int, tile: int) -> DataFrame:
    """Written pieces of groups of sketches near each other on the first axis, each with the box of their leading dimensions."""
    parts = max(1, -(-n // GROUP), min(LANES, -(-n // tile)))
    near = classes.repartitionByRange(parts, "lead", "id").select("id", "code", "off")
    schema = "block bigint, ids binary, codes binary, offs binary, low array<double>, high array<double>"

    def piece(table: pa.Table) -> pa.RecordBatch:
        code, off = numbers(table.column("code"), np.int8), np.arcsin(np.minimum(table.column("off").to_numpy(), 1))
        u = units(code)[:, :BOX].astype(np.float64)
        # A unit sketch is off by no more than the length of that arc.
        box = (u - off[:, None]).min(axis=0) - SINGLE, (u + off[:, None]).max(axis=0) + SINGLE
        columns = [
            pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([table.column("id").to_numpy().astype("<i8").tobytes()]),
            pa.array([code.tobytes()]), pa.array([np.nextafter(off.astype("<f4"), np.float32(4)).tobytes()]), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in box],
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= PIECE:
                yield piece(pa.Table.from_batches(held))
                held = []
        if sum(map(len, held)):
            yield piece(pa.Table.from_batches(held))

    return written(near.mapInArrow(each, schema), "sketches")


def clusters(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by the nearest of some of them, the pivots, and by how near that is; where each pivot's rows begin; the pivots."""
    pivots = u[:: max(1, min(LEAF, len(u)))]
    nearest, close = np.empty(len(u), np.int64), np.empty(len(u), np.float32)
    step = max(1, 16 * PRODUCTS // len(pivots))
    for at in range(0, len(u), step):
        products = u[at : at + step] @ pivots.T
        nearest[at : at + step], close[at : at + step] = products.argmax(axis=1), products.max(axis=1)
    order = np.lexsort((-close, nearest))
    return order, np.searchsorted(nearest[order], np.arange(len(pivots) + 1)), pivots


def may_link(a: np.ndarray, b: np.ndarray | None, off_a: np.ndarray, off_b: np.ndarray, angle: float) -> np.ndarray:
    """Of unit sketches (a, then b), the least row that links of up to an angle may lead to; without b, of a among themselves.

    Sketches are off by angles of their own, so two of them may link up to the angle and both of these. As the cosine
    falls no faster than the angle grows, and near the angle by a slope, the second of them is added to the cosine.
    """
    same = b is None
    order, at, pivots = clusters(a)
    a, off_a = a[order], off_a[order]
    b, off_b = (a, off_a) if same else (b, off_b)
    shift = 0 if same else len(a)
    label = np.arange(shift + len(b))
    more = (off_b * np.sin(min(np.pi / 2, angle + off_a.max() + off_b.max()))).astype(np.float32)

    def first(u: np.ndarray, last: np.ndarray) -> np.ndarray:
        short = u[:, :FIRST]
        return np.column_stack([short, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", short, short), 0)), last])

    fa, fb = first(a, np.ones(len(a), np.float32)), first(b, more)
    wider = np.column_stack([b, off_b.astype(np.float32)])
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> None:
        nonlocal label
        if pending:
            i, j = (np.concatenate(x) for x in zip(*pending, strict=True))
            label = roots(len(label), label[i], label[j])[label]
            pending.clear()

    def meet(start: int, end: int, pivot: np.ndarray, near: np.ndarray) -> None:
        """Rows of one pivot, and what of the other side can be that near to it."""
        most = angle + off_a[start:end].max()
        wide = np.arccos(np.clip((a[start:end] @ pivot).min() - SINGLE, -1, 1))
        reach = np.flatnonzero(near >= np.cos(min(np.pi, wide + most)) - SINGLE)
        if same:
            reach = reach[np.searchsorted(reach, start) :]
        least = np.float32(np.cos(min(np.pi, most)) - SINGLE)
        step = PRODUCTS // ROWS
        for s in range(0, len(reach), step):
            own = reach[s : s + step]
            i, j = np.divmod(np.flatnonzero(fa[start:end] @ fb[own].T >= least), len(own))
            i, j = i + start, own[j]
            new = label[i] != label[j + shift]
            i, j = i[new], j[new]
            for c in range(0, len(i), JOINED):
                x, y = i[c : c + JOINED], j[c : c + JOINED]
                found = np.einsum("ij,ij->i", a[x], b[y]) + more[y] >= least
                if found.any():
                    pending.append((x[found], y[found] + shift))
            if sum(len(x) for x, _ in pending) >= JOINED:
                join()

    together = max(1, 16 * PRODUCTS // max(1, len(b)))
    for some in range(0, len(pivots), together):
        near = np.column_stack([pivots[some : some + together], np.ones(len(pivots[some : some + together]), np.float32)]) @ wider.T
        for k, own in enumerate(near, some):
            for start in range(at[k], at[k + 1], ROWS):
                meet(start, min(start + ROWS, at[k + 1]), pivots[k], own)
    join()
    # Back to the rows as they came: the least row of each label.
    place = np.concatenate([order, np.arange(len(order), len(label))])
    low = np.full(len(label), len(label))
    np.minimum.at(low, label, place)
    out = np.empty(len(label), np.int64)
    out[place] = low[label]
    return out


def tile_pairs(made: DataFrame, least: float) -> DataFrame:
    """(a, b) with a <= b of tiles that can hold a linked pair: near on the first axis, and by their boxes."""
    reach = float(np.sqrt(max(2 - 2 * least, 1e-6)))
    cell = lambda x: F.floor(x / reach)
    box = made.select("block", "low", "high")
    wide = box.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0] - reach), cell(F.col("high")[0] + reach))))
    own = box.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))))
    one = wide.select("cell", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    two = own.select("cell", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y),
            lambda x, y: F.greatest(x, y, F.lit(0.0)),
        ),
        F.lit(0.0), lambda s, x: s + x * x,
    )
    return one.join(two, "cell").filter((F.col("a") <= F.col("b")) & (gap <= 2 - 2 * least + DOUBLE)).select("a", "b").distinct()


def may_link_pairs(made: DataFrame, least: float) -> DataFrame:
    """(a, b): ids of sketches that may belong together, as one link to the first of them for each pair of groups."""
    pairs = written(tile_pairs(made, least), "group-pairs")
    one = made.select(F.col("block").alias("a"), "ids", "codes", "offs")
    two = made.select(F.col("block").alias("b"), "ids", "codes", "offs")
    # Each pair of groups is a group of its own: some pieces on either side, on one if it is the same.
    left = pairs.join(one, "a").select("a", "b", "ids", "codes", "offs")
    right = pairs.filter("a <> b").join(two, "b").select(*[F.col(c).alias(f"{c}_too") for c in left.columns])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, codes, offs = [], [], []
        same = not len(y)
        for side in (x,) if same else (x, y.rename_columns(x.column_names)):
            for column, kind, out in (("ids", np.int64, ids), ("codes", np.int8, codes), ("offs", np.float32, offs)):
                out.append(np.frombuffer(b"".join(side.column(column).to_pylist()), kind))
            codes[-1] = codes[-1].reshape(len(ids[-1]), -1)
        both = np.concatenate(ids)
        root = np.arange(len(both))
        # A group has room as bytes; as numbers it is taken a slice at a time.
        for s in range(0, len(codes[0]), SLICE):
            a = units(codes[0][s : s + SLICE])
            for t in range(s if same else 0, len(codes[-1]), SLICE):
                b = None if same and s == t else units(codes[-1][t : t + SLICE])
                found = may_link(a, b, offs[0][s : s + SLICE], offs[-1][t : t + SLICE], float(np.arccos(min(least, 1.0))))
                at = np.concatenate([np.arange(s, s + len(a)), np.arange(t, t + len(found) - len(a)) + (0 if same else len(ids[0]))])
                led = np.flatnonzero(found != np.arange(len(found)))
                root = roots(len(root), root[at[led]], root[at[found[led]]])[root]
        led = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": both[led], "b": both[root[led]]})

    return left.groupBy("a", "b").cogroup(right.groupBy("a_too", "b_too")).applyInArrow(meet, "a bigint, b bigint")


def links(ids: list[np.ndarray], weights: list[np.ndarray], data: list[np.ndarray], same: bool, axes: np.ndarray, least: float) -> pa.Table:
    """Counts and roots of the linked rows of two sides, or of one with itself, from whole vectors."""
    n = [np.zeros(len(v)) for v in ids]
    shift = 0 if same else len(ids[0])
    node = np.arange(shift + len(ids[1]))
    for i, j in close_pairs(*data, axes, least):
        if same:
            i, j = i[i < j], j[i < j]
        n[0] += np.bincount(i, weights[1][j], minlength=len(n[0]))
        n[0 if same else 1] += np.bincount(j, weights[0][i], minlength=len(n[0 if same else 1]))
        # Only what the links lead to is kept, never the links of a strip.
        if len(i):
            node = roots(len(node), np.concatenate([np.arange(len(node)), i]), np.concatenate([node, j + shift]))
    both = ids[0] if same else np.concatenate(ids)
    counts = n[0] if same else np.concatenate(n)
    found = counts > 0
    return pa.table({"id": both[found], "n": counts[found].astype(np.int64), "root": both[node[found]]})


def linked(rows: DataFrame, d: int, wanted: DataFrame, axes: np.ndarray, least: float, most: int) -> DataFrame:
    """id, n, root of the links within each ``comp`` of the wanted rows (key, id, n, comp, size), from whole vectors.

    Sets of up to ``most`` rows are compared by the task that has them, larger ones in as many tiles as that takes.
    """
    kind = np.float32 if single(rows) else np.float64
    schema = "id bigint, n bigint, root bigint"

    def once(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, weights and vectors; of rows that stand there twice, one."""
        _, at = np.unique(numbers(table.column("key"), "S16").ravel(), return_index=True)
        table = table.take(np.sort(at))
        return table.column("id").to_numpy(), table.column("n").to_numpy().astype(float), numbers(table.column("data"), kind).astype(np.float64)

    def sets(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole sets, in order: small ones some at a time, though each pair of rows of another set stays unlinked."""
        ends = np.append(np.flatnonzero(np.diff(table.column("comp").to_numpy())) + 1, len(table))
        start = 0
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] - start > UNIT:
                own, weight, data = once(table.slice(start, end - start))
                yield from links([own] * 2, [weight] * 2, [data] * 2, True, axes, least).to_batches()
                start = end

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                comp = table.column("comp").to_numpy()
                last = int(np.argmax(comp == comp[-1]))
                if last:
                    yield from sets(table.slice(0, last))
                held = table.slice(last).to_batches()
        if sum(map(len, held)):
            yield from sets(pa.Table.from_batches(held).combine_chunks())

    def chosen(ids: DataFrame) -> DataFrame:
        return fetch(keyed(rows, d, data=True), ids, ["key", "id"], few=0)

    small = chosen(wanted.filter(F.col("size") <= most)).repartition("comp").sortWithinPartitions("comp").mapInArrow(each, schema)
    crowds = wanted.filter(F.col("size") > most)
    if crowds.isEmpty():
        return small
    tiles = F.ceil(F.col("size") / most)
    large = written(chosen(crowds).withColumn("tile", F.pmod(F.xxhash64("key"), tiles)).withColumn("last", tiles - 1), "crowds")
    left = large.withColumn("a", F.col("tile")).withColumn("b", F.explode(F.sequence("tile", "last")))
    right = large.withColumn("b", F.col("tile")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tile"))))
    columns = ["comp", "a", "b", "key", "id", "n", "data"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        same = x.column("a")[0].as_py() == x.column("b")[0].as_py()
        ids, weights, data = zip(once(x), once(y.rename_columns(columns)), strict=True)
        return links(list(ids), list(weights), list(data), same, axes, least)

    names = ["comp", "a", "b"]
    right = right.select(*[F.col(c).alias(f"{c}_too") for c in columns])
    met = left.select(*columns).groupBy(*names).cogroup(right.groupBy(*[f"{c}_too" for c in names])).applyInArrow(meet, schema)
    return small.unionByName(met)


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tile: int = TILE
) -> DataFrame:
    """id, n_links (other vectors with cosine of at least ``least``), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.withColumn("vector", F.col("vector").cast("array<float>" if single(rows) else "array<double>"))
    d = usual_length(rows)
    if not d:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
        )
    with dropped_shuffles(spark):
        axes = rotation(rows, d)
        one = F.first(F.struct("lead", "code", "off")).alias("one")
        told = keyed(rows, d, axes).groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), one)
        classes = written(told.select("key", "id", "n", "one.*"), "vector-classes", keep=True)
        with owned_tables(spark):
            made = groups(classes, classes.count(), tile)
            met = components(may_link_pairs(made, least))
            sets = written(met.select(F.col("node").alias("id"), F.col("component").alias("comp")), "vector-sets", keep=True)
        with owned_tables(spark):
            sizes = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
            wanted = classes.select("key", "id", "n").join(sets, "id").join(sizes, "comp").select("key", "id", "n", "comp", "size")
            most = max(tile, min(TILES * tile, ROOM // (d * (4 if single(rows) else 8))))
            found = written(linked(rows, d, written(wanted, "wanted"), axes, least, most), "vector-links", keep=True)
        together = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("id").agg(F.sum("n").alias("links"))
        told = classes.select("key", "id", "n").join(counts, "id", "left").join(together.withColumnRenamed("node", "id"), "id", "left").select(
            F.col("key").alias("head"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"), "n"
        )
    own = keyed(rows, d)
    named = own.join(told, own["key"] == told["head"], "left")
    return named.select(
        F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
