"""Word blocks: documents as numbers into a small dictionary, so that each distinct word travels once a block.

A block holds whole documents of one Arrow batch, up to about ``tokens_per_block`` words. Its words with
their numbers are dealt out over parts by checksum, packed; each part works on each of its distinct words
once and sends the results back to the blocks, where they are put in the words' places. A word comes once
from a block, so no word is hot; no block is larger than its bound or one document, no part than its bound.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import giving_back, written_in_buckets

TOKENS_PER_BLOCK = 1_500_000
#: Words of all blocks that meet in a part.
WORDS_PER_PART = 250_000
#: Fixed value: the characters with the property White_Space, as the tokenizers' ``\s`` has them.
WHITE_SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def jvm_pattern(pattern: str) -> str:
    """A tokenizer's pattern with its white space spelled out, as Java's ``\\s`` knows ASCII only."""
    pattern = pattern.replace(r"[^\s", "[^" + WHITE_SPACE)
    return pattern.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, their low, second, ... bytes side by side and compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_strings(items: list[bytes]) -> bytes:
    sizes = pack(np.fromiter(map(len, items), np.uint32, len(items)))
    return struct.pack("<I", len(sizes)) + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(items))


def unpack_strings(data: bytes) -> list[bytes]:
    at = 4 + struct.unpack_from("<I", data)[0]
    ends = np.cumsum(unpack(data[4:at]), dtype=np.int64).tolist()
    text = zstandard.ZstdDecompressor().decompress(data[at:])
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def split_blocks(
    docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens_per_block: int = TOKENS_PER_BLOCK
) -> DataFrame:
    """A table, written by block, with a row for each: its number, words, and of each document id, length and word numbers."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tokens = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.regexp_extract_all(text, F.lit(jvm_pattern(pattern)), F.lit(0)).alias("tokens")
    )
    id_type = tokens.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("tokens")
            ends = np.asarray(lists.offsets)
            first = 0
            while first < len(batch):
                most = np.searchsorted(ends, ends[first] + tokens_per_block, side="right") - 1
                last = min(max(first + 1, most), len(batch))
                coded = lists.values.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
                words, codes = coded.dictionary, np.asarray(coded.indices)
                # Numbers in order of frequency are small where they are many.
                order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
                place = np.empty(len(words), np.uint32)
                place[order] = np.arange(len(words), dtype=np.uint32)
                packed = pack_strings(words.take(pa.array(order)).cast(pa.binary()).to_pylist())
                columns = [
                    pa.array([number], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([packed], pa.binary()),
                    pa.ListArray.from_arrays([0, last - first], batch.column("id").slice(first, last - first)),
                    pa.array([pack(np.diff(ends[first : last + 1]))], pa.binary()), pa.array([pack(place[codes])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n_words", "words", "ids", "sizes", "codes"])
                number += 1
                first = last

    schema = f"block bigint, n_words bigint, words binary, ids array<{id_type}>, sizes binary, codes binary"
    return written_in_buckets(tokens.mapInArrow(giving_back(split), schema), "block", "word_blocks")


def deal_words(blocks: DataFrame, words_per_part: int = WORDS_PER_PART) -> DataFrame:
    """(part, block, numbers, words): the words of the blocks by part, in as many parts as keep each within its bound."""
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-total // words_per_part))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                words = unpack_strings(packed.as_py())
                part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                for numbers in np.split(order, cuts) if len(order) else []:
                    row = [int(part[numbers[0]]), block, pack(numbers), pack_strings([words[i] for i in numbers.tolist()])]
                    yield pa.RecordBatch.from_pylist([dict(zip(("part", "block", "numbers", "words"), row, strict=True))], schema=arrow)

    arrow = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())])
    return blocks.select("block", "words").mapInArrow(giving_back(deal), "part bigint, block bigint, numbers binary, words binary")


def for_each_word(dealt: DataFrame, start: Callable[[], Callable[[list[bytes]], list[bytes]]]) -> DataFrame:
    """(block, numbers, results): ``start()`` gives, in each task, what makes the results of a part's sorted distinct words."""

    def finish(rows: list[dict], work: Callable) -> pa.RecordBatch:
        own = [unpack_strings(row["words"]) for row in rows]
        distinct = sorted(set().union(*own))
        result = dict(zip(distinct, work(distinct), strict=True))
        out = [
            {"block": row["block"], "numbers": row["numbers"], "results": pack_strings([result[w] for w in words])}
            for row, words in zip(rows, own, strict=True)
        ]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("results", pa.binary())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["part"] != rows[0]["part"]:
                    yield finish(rows, work)
                    rows = []
                rows.append(row)
        if rows:
            yield finish(rows, work)

    by_part = dealt.repartition("part").sortWithinPartitions("part")
    return by_part.mapInArrow(giving_back(each), "block bigint, numbers binary, results binary")


def by_block(results: DataFrame, blocks: DataFrame, work: Callable[[list[bytes], pa.Array, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work(results in order of number, ids, sizes, codes)`` for each block: sizes of its documents, codes of its words."""

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [b""] * right.column("n_words")[0].as_py()
        for numbers, packed in zip(left.column("numbers"), left.column("results"), strict=True):
            for i, value in zip(unpack(numbers.as_py()).tolist(), unpack_strings(packed.as_py()), strict=True):
                found[i] = value
        sizes, codes = (unpack(right.column(c)[0].as_py()) for c in ("sizes", "codes"))
        return work(found, right.column("ids")[0].values, sizes, codes)

    rest = blocks.select("block", "n_words", "ids", "sizes", "codes")
    return results.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(together, schema)
