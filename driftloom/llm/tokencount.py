"""Token counts under a unigram model, scored once for each shared prefix of the corpus's words.

A word is cut into the pieces of a vocabulary whose summed cost is least (of equal costs, the fewest pieces).
The best cost up to a byte depends only on the bytes before it, so distinct words are put into a trie and each
node is scored once, from its ancestors; a word's count is what its last node holds. Counts go back to the
documents by word blocks. A null or empty text has no tokens; repeated rows are counted each for itself; only
the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.blocks import TOKENS_PER_BLOCK, WORDS_PER_PART, by_block, deal_words, for_each_word, split_blocks

#: Costs are whole numbers, so that equal ones are equal.
SCALE = 1 << 16


def unigram_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Cost of each piece: minus the logarithm of a frequency that falls as one by rank."""
    total = math.log(sum(1 / (r + 2) for r in ranks.values()) or 1)
    return {piece: round(SCALE * (math.log(rank + 2) + total)) for piece, rank in ranks.items()}


def trie_counter(costs: dict[bytes, int]) -> Callable[[list[bytes]], list[bytes]]:
    """Counts of sorted words. The path from the root to the current node is all of the trie that is held."""
    # All ends of pieces, to stop looking back as soon as no piece ends so.
    ends = {piece[i:] for piece in costs for i in range(len(piece))}

    def work(words: list[bytes]) -> list[bytes]:
        best: list[tuple[int, int]] = [(0, 0)]
        last, out = b"", []
        for word in words:
            shared = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :]
            for node in range(shared + 1, len(word) + 1):
                least = None
                for start in range(node - 1, -1, -1):
                    piece = word[start:node]
                    if piece not in ends:
                        break
                    cost = costs.get(piece)
                    if cost is not None:
                        so_far, count = best[start]
                        found = (so_far + cost, count + 1)
                        if least is None or found < least:
                            least = found
                # A byte that no piece has is a token of its own, dearer than any piece.
                best.append(least or (best[node - 1][0] + 64 * SCALE, best[node - 1][1] + 1))
            out.append(best[len(word)][1].to_bytes(4, "little"))
            last = word
        return out

    return work


def add_up(found: list[bytes], ids: pa.Array, sizes: np.ndarray, codes: np.ndarray) -> pa.Table:
    counts = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(counts[codes])])
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.table({"id": ids, "n_words": pa.array(np.diff(ends), pa.int64()), "n_tokens": pa.array(np.diff(sums[ends]), pa.int64())})


def count_tokens(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text",
    tokens_per_block: int = TOKENS_PER_BLOCK, words_per_part: int = WORDS_PER_PART,
) -> DataFrame:
    """The id column, n_words (pre-tokens) and n_tokens of each text. A vocabulary piece's rank sets its cost."""
    shared = docs.sparkSession.sparkContext.broadcast(unigram_costs(ranks))
    blocks = split_blocks(docs, pattern, id_col, text_col, tokens_per_block)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    results = for_each_word(deal_words(blocks, words_per_part), lambda: trie_counter(shared.value))
    out = by_block(results, blocks, add_up, f"id {id_type}, n_words bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
