"""Byte-level BPE: every distinct word of the corpus is encoded once and its ids are joined back by position.

A null or empty text has no ids and decodes to no bytes. Ids, nulls among them, and repeated rows are
carried along as they are: one row out for each row in. Other columns play no part.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.blocks import TOKENS_PER_BLOCK, WORDS_PER_PART, by_block, deal_words, for_each_word, split_blocks
from driftloom.llm.common import giving_back

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words that are put together, and documents that are decoded, at once.
REBUILD_WORDS = 250_000
DECODE_ROWS = 250


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    """The token-byte table: a fixed vocabulary, about 1 MB, read where the driver runs and sent along."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def id_type(ranks: dict[bytes, int]) -> str:
    """The shortest whole number that holds every id."""
    return "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"


def word_encoder(ranks: dict[bytes, int]) -> Callable[[list[bytes]], list[bytes]]:
    """Whole words, split by the caller's pattern already, to the bytes of their ids."""
    encoding = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    code = "H" if id_type(ranks) == "<u2" else "I"

    def work(words: list[bytes]) -> list[bytes]:
        return [array(code, encoding.encode_ordinary(w.decode())).tobytes() for w in words]

    return work


def rebuild(found: list[bytes], ids: pa.Array, sizes: np.ndarray, codes: np.ndarray, kind: str) -> pa.Table:
    """The ids of each document of a block, in order of position."""
    n = np.fromiter(map(len, found), np.int32, len(found)) // np.dtype(kind).itemsize
    flat, starts = np.frombuffer(b"".join(found), kind), np.cumsum(n, dtype=np.int64) - n
    values = []
    for at in range(0, len(codes), REBUILD_WORDS):
        part = codes[at : at + REBUILD_WORDS]
        size = n[part]
        values.append(flat[np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype("<i4"))
    ends = np.concatenate([[0], np.cumsum(n[codes])])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
    joined = np.concatenate([*values, np.zeros(0, "<i4")])
    return pa.table({"id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined, pa.int32()))})


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens_per_block: int = TOKENS_PER_BLOCK,
    words_per_part: int = WORDS_PER_PART,
) -> DataFrame:
    """The id column and ``ids``, the token ids of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    blocks = split_blocks(docs, pattern, id_col, text_col, tokens_per_block)
    results = for_each_word(deal_words(blocks, words_per_part), lambda: word_encoder(shared.value))
    kind, of_id = id_type(ranks), blocks.schema["ids"].dataType.elementType.simpleString()
    put = lambda *block: rebuild(*block, kind)
    return by_block(results, blocks, put, f"id {of_id}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of a list of ids, through the token-byte table (fixed size, sent to every task)."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for whole in batches:
            for at in range(0, len(whole), DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                lists = batch.column(ids_col)
                ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
                texts = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out])

    before = encoded.drop(out).withColumn(ids_col, F.coalesce(F.col(f"`{ids_col}`"), F.expr("cast(array() as array<int>)")))
    return before.mapInArrow(giving_back(each), T.StructType([*before.schema.fields, T.StructField(out, T.BinaryType())]))
