"""Language ID by compression: the language whose dictionary compresses a text best.

Fitting reads a bounded sample of labelled rows; predictions read whole texts. A null text, and a text
without a letter, is ``und`` and rejected; so is every text when no labelled row was there to learn
from. Extra columns and repeated rows are carried along; the three new columns replace any of their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import giving_back

UNKNOWN = "und"
#: Bounds of the sample: documents of a language, and characters of each, that make its dictionary.
SAMPLE_DOCS = 96
SAMPLE_CHARS = 2_000
#: Languages at most, the most frequent first; so the dictionaries have a fixed largest size.
SAMPLE_LANGUAGES = 200
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts in long ones as in short.
PIECE = 4_096
LEVEL = 7
#: The second-best size must be larger by this share of the best, or the text is rejected.
LEAST_MARGIN = 0.001
#: What is no part of a word; such runs are one space each in what is compressed.
GAPS = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    """A text's words in lower case."""
    return GAPS.sub(" ", text.lower()).encode()


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS,
    languages: int = SAMPLE_LANGUAGES,
) -> dict[str, bytes]:
    """Language -> raw-content dictionary, from ``docs`` texts of each language, those whose hash is smallest.

    The most that comes to the driver is languages x docs x chars. Rows without a language, or whose text
    has no letter, teach nothing. Equal texts count once.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    # Hashes are made distinct before they are ranked, so copies take no places; at most languages x docs of them remain.
    part = rows.select("lang", F.substring("text", 1, chars).alias("text"), F.xxhash64("text").alias("at"))
    nearest = W.partitionBy("lang").orderBy("at")
    chosen = part.select("lang", "at").distinct().withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= docs)
    chosen = chosen.join(known, "lang", "left_semi").drop("n")
    sample = part.join(F.broadcast(chosen), ["lang", "at"], "left_semi").distinct()
    found: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["at"])):
        found.setdefault(row["lang"], []).append(row["text"])
    return {k: b" ".join(map(fold, v)) for k, v in found.items()}


def judge(texts: pa.Array, compressors: dict[str, zstandard.ZstdCompressor], least: float) -> pa.Array:
    """lang_pred, score and rejected of each text; equal sizes go to the language first in order. One text at a time leaves the batch."""
    out = []
    for text in texts:
        text = text.as_py()
        if text is None or not any(map(str.isalpha, text)) or not compressors:
            out.append((UNKNOWN, 0.0, True))
            continue
        data = fold(text)
        sizes = sorted(
            (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)), lang) for lang, c in compressors.items()
        )
        if len(sizes) == 1:
            out.append((sizes[0][1], 1.0, False))
            continue
        margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
        out.append((sizes[0][1], min(1.0, margin / (margin + 0.02)), margin < least))
    lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
    columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
    return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "rejected"])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1, from the margin) and rejected; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = {}
        for lang, data in sorted(shared.value.items()):
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            compressors[lang] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        for texts in batches:
            yield judge(texts, compressors, least_margin)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(tell)(batches)

    new = ("lang_pred", "score", "rejected")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out = docs.select(F.struct(*kept).alias("__row"), judged(F.col(f"`{text}`")).alias("__new"))
    return out.select("__row.*", "__new.*")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting, by the checksum of its number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
