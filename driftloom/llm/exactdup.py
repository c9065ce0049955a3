"""Exact deduplication: owners of equal texts, found in compressed radix tries.

A task puts the texts of a bounded block into a trie of its own and sends on one row for each distinct text, with
how many rows have it and which id is to own it. Length and content hash deal out the texts that several blocks
have; a part inserts their full byte strings into one trie, whose terminal nodes hold the owner. So equal hashes
decide nothing: only equal bytes meet in a node. A trie beyond its budget hands its largest subtrees on, each as a
part of its own in the next round. A text that very many blocks have is first combined in lanes.

Null counts as an empty text, and all empty texts are equal. Rows without id are members of their group and own it only
if no row of it has an id; then the owner is null and they all stay. Repeated rows are members each for itself; if they
have the owner's id, they all stay. An empty table has no groups. Only the id and the text are read, whatever
else the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import written

#: Bytes of text in a block of a task, in a part on the average, and in a trie before it hands subtrees on.
BLOCK_BYTES, PART_BYTES, TRIE_BYTES = 32 << 20, 48 << 20, 128 << 20
#: Blocks with one text beyond which they are combined in lanes first.
LANE_BLOCKS = 1024
#: What a node costs besides its label.
NODE_BYTES = 300
#: Rows of an output batch, and bytes of text in it.
OUT_ROWS, OUT_BYTES = 8192, 8 << 20

_NODES = "part bigint, node bigint, length bigint, hash bigint, text binary, best bigint, n bigint"
_LINK, _OWNER, _PASSED = 0, 1, 2


class Node:
    """``stub`` is the part that the texts below it go to; ``cut`` tells that there is a stub somewhere below."""

    __slots__ = ("label", "below", "value", "stub", "cut")

    def __init__(self, label: bytes, stub: int | None = None, cut: bool = False) -> None:
        self.label, self.below, self.value, self.stub, self.cut = label, {}, None, stub, cut


class Trie:
    """A compressed radix trie over byte strings; ``size`` is about what it holds in memory."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.size = 0

    def at(self, text: bytes) -> Node:
        """The node where the text ends, made if need be; or the stub of the subtree it belongs to."""
        node, place, end = self.root, 0, len(text)
        while place < end and node.stub is None:
            child = node.below.get(text[place])
            if child is None:
                child = Node(text[place:])
                node.below[text[place]] = child
                self.size += end - place + NODE_BYTES
                return child
            label = child.label
            if text.startswith(label, place):
                place += len(label)
            else:
                same = common(label, text, place)
                upper = Node(label[:same], cut=child.cut or child.stub is not None)
                upper.below[label[same]] = child
                child.label = label[same:]
                node.below[text[place]] = upper
                self.size += NODE_BYTES
                place += same
                child = upper
            node = child
        return node

    def walk(self, node: Node, path: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """(text, value) of the terminal nodes at and below a node that stands at ``path``."""
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                yield path, node.value
            stack += [(child, path + child.label) for child in node.below.values()]

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack += node.below.values()
        return total

    def shed(self, stub: int) -> list[tuple[bytes, list]]:
        """Takes out the heaviest subtree that leaves something behind, and puts a stub there; nothing if there is none.

        A subtree that has a stub below stays, as texts of that stub have gone to another part; what is below it may go.
        """
        node, path, left, line = self.root, b"", 0, ()
        while len(node.below) == 1 and node.value is None and node.stub is None and not node.cut:
            line += (node,)
            node = next(iter(node.below.values()))
            path += node.label
        whole, stack = [], [(node, path, line)]
        while stack:
            node, path, above = stack.pop()
            left += node.value is not None
            for child in node.below.values():
                if child.cut:
                    stack.append((child, path + child.label, (*above, node)))
                elif child.stub is None:
                    whole.append((node, child, path + child.label, (*above, node)))
        if left + len(whole) < 2 or not whole:
            return []
        node, heavy, path, above = max(whole, key=lambda w: self.weight(w[1]))
        gone = list(self.walk(heavy, path))
        self.size -= self.weight(heavy) - NODE_BYTES
        # All texts that go on with this byte belong to the subtree, also those that would split its label.
        node.below[heavy.label[0]] = Node(heavy.label[:1], stub=stub)
        for upper in above:
            upper.cut = True
        return gone


def common(label: bytes, text: bytes, place: int) -> int:
    """How many bytes of the label the text has at a place, by halving."""
    low, high = 0, min(len(label), len(text) - place)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[place + low : place + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def content_hash(text: bytes) -> int:
    """64 bits, signed."""
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _better(a: int | None, b: int | None, pick: Callable) -> int | None:
    return b if a is None else a if b is None else pick(a, b)


class _Out:
    """Rows put together to Arrow batches of bounded rows and bytes."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.rows, self.bytes = [], 0


def distinct_in_blocks(rows: DataFrame, pick: Callable, hashed: Callable[[bytes], int], block_bytes: int) -> DataFrame:
    """A written table with a row for each distinct text of each block: its node, members, digest, owner so far and bytes."""
    schema = pa.schema([
        ("node", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("best", pa.int64()),
        ("n", pa.int64()), ("members", pa.list_(pa.int64())), ("digest", pa.string()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        out, trie, held = _Out(schema), Trie(), 0

        def end_block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for text, members in trie.walk(trie.root):
                best = None
                for member in members:
                    best = _better(best, member, pick)
                row = (number, len(text), hashed(text), text, best, len(members), members, hashlib.sha256(text).hexdigest())
                yield from out.add(row, len(text) + 8 * len(members))
                number += 1

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                node = trie.at(text)
                if node.value is None:
                    node.value = []
                node.value.append(i)
                held += 8
                if trie.size + held >= block_bytes:
                    yield from end_block()
                    trie, held = Trie(), 0
        yield from end_block()
        yield from out.flush()

    made = "node bigint, length bigint, hash bigint, text binary, best bigint, n bigint, members array<bigint>, digest string"
    return written(rows.mapInArrow(each, made), "distinct-texts")


def merge(nodes: DataFrame, parts: int, pick: Callable, trie_bytes: int, texts: bool) -> DataFrame:
    """One round: a trie for each part, as a written table of links, owners and rows that are passed on.

    A link leads from a node to the one that stands for its text; an owner row has the node's best id and number of
    rows, and its text if ``texts``; passed rows are nodes again, each with the part of its subtree.
    """
    schema = pa.schema([("kind", pa.int8()), ("into", pa.int64())] + [
        (name, pa.binary() if name == "text" else pa.int64()) for name in ("part", "node", "length", "hash", "text", "best", "n")
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Negative numbers are parts of subtrees; a task makes them from its own number, so they never clash.
        stubs = -((TaskContext.get().partitionId() + 1) << 32)
        out, trie, current = _Out(schema), Trie(), None

        def end_part() -> Iterator[pa.RecordBatch]:
            for text, (node, length, hash_, best, n) in trie.walk(trie.root):
                row = (_OWNER, None, None, node, length, hash_, text if texts else None, best, n)
                yield from out.add(row, len(text) if texts else 0)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "length", "hash", "text", "best", "n")), strict=True):
                part, node, length, hash_, text, best, n = row
                if part != current:
                    yield from end_part()
                    trie, current = Trie(), part
                place = trie.at(text)
                if place.stub is not None:
                    yield from out.add((_PASSED, None, place.stub, *row[1:]), len(text))
                elif place.value is None:
                    place.value = [node, length, hash_, best, n]
                else:
                    place.value[3] = _better(place.value[3], best, pick)
                    place.value[4] += n
                    yield from out.add((_LINK, place.value[0], None, node, None, None, None, None, None), 0)
                while trie.size > trie_bytes:
                    gone = trie.shed(stubs)
                    if not gone:
                        break
                    for text, (node, length, hash_, best, n) in gone:
                        yield from out.add((_PASSED, None, stubs, node, length, hash_, text, best, n), len(text))
                    stubs += 1
        yield from end_part()
        yield from out.flush()

    dealt = nodes.select(*[c.split()[0] for c in _NODES.split(", ")]).repartition(parts, "part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(each, "kind tinyint, into bigint, " + _NODES), "text-tries")


def _settle(nodes: DataFrame, parts: int, pick: Callable, trie_bytes: int, texts: bool) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of :func:`merge` until no subtree is passed on: the links of each round, and the owners of all."""
    links, owners = [], None
    while True:
        out = merge(nodes, parts, pick, trie_bytes, texts)
        links.append(out.filter(F.col("kind") == _LINK).select("node", "into"))
        found = out.filter(F.col("kind") == _OWNER).select("node", "length", "hash", "text", "best", "n")
        owners = found if owners is None else owners.unionByName(found)
        nodes = out.filter(F.col("kind") == _PASSED)
        if nodes.isEmpty():
            return links, owners


def exact_owners(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    largest: bool = False,
    normal: Callable[[Column], Column] = lambda text: text,
    hashed: Callable[[bytes], int] = content_hash,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
    trie_bytes: int = TRIE_BYTES,
    lane_blocks: int = LANE_BLOCKS,
) -> DataFrame:
    """(id, owner, group_size, kept, digest) of every row: the owner has the smallest id of its text, or the largest.

    ``normal`` is what texts undergo before they are compared; the digest is that of the result.
    """
    pick = max if largest else min
    text = normal(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.cast("binary").alias("text"))
    found = distinct_in_blocks(rows, pick, hashed, block_bytes)

    # Most texts have a length and hash of their own and need not travel.
    met = found.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")
    met = written(met, "met-texts")
    here = found.select("node", "members", "digest", F.col("best").alias("own"), F.col("n").alias("own_n"), F.col("node").alias("at"))
    if not met.isEmpty():
        some = found.select("node", "length", "hash", "text", "best", "n").join(met, ["length", "hash"])
        key = F.xxhash64("length", "hash")
        links: list[DataFrame] = []
        hot = met.filter(F.col("blocks") > lane_blocks)
        size = met.agg(F.sum(F.col("blocks") * (F.col("length") + NODE_BYTES))).first()[0]
        parts = max(1, -(-size // part_bytes))
        if not hot.isEmpty():  # about as many lanes as blocks in a lane, so that neither step meets many
            lanes = F.ceil(F.sqrt("blocks"))
            apart = some.filter(F.col("blocks") > lane_blocks).withColumn("part", F.abs(F.xxhash64(key, F.pmod(F.xxhash64("node"), lanes))))
            links, owners = _settle(apart, max(parts, docs.sparkSession.sparkContext.defaultParallelism), pick, trie_bytes, True)
            some = some.filter(F.col("blocks") <= lane_blocks).drop("blocks").unionByName(owners)
        more, owners = _settle(some.withColumn("part", F.pmod(key, F.lit(parts))), parts, pick, trie_bytes, False)
        for step in [*links, *more]:
            here = here.join(step.select(F.col("node").alias("at"), "into"), "at", "left").withColumn("at", F.coalesce("into", "at")).drop("into")
        here = here.join(owners.select(F.col("node").alias("at"), "best", "n"), "at", "left")
        # Owners of a text that several blocks have; a node without one is the only one with its text.
        here = here.withColumn("own_n", F.coalesce("n", "own_n")).withColumn("own", F.when(F.col("n").isNotNull(), F.col("best")).otherwise(F.col("own")))
    return here.select(F.explode("members").alias("id"), "own", "own_n", "digest").select(
        F.col("id").alias(id_col), F.col("own").alias("owner"), F.col("own_n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("own")).alias("kept"), "digest",
    )
