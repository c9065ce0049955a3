"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import langid
from driftloom.llm.ann import search
from driftloom.llm.bpe import decode, encode, load_ranks
from driftloom.llm.chat import format_chat
from driftloom.llm.common import table, written
from driftloom.llm.embdedup import link_vectors
from driftloom.llm.exactdup import exact_owners
from driftloom.llm.hardneg import mine_hard_negatives
from driftloom.llm.langid import held_out
from driftloom.llm.minhash import near_duplicates
from driftloom.llm.mixing import mix
from driftloom.llm.repair import COUNTS, damaged, digests, lines_of, repair_conversations
from driftloom.llm.secrets import BASE_KINDS, secret_spans, span_list
from driftloom.llm.substring import dedup_substrings
from driftloom.llm.tokencount import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every document, as spans; a null text has none."""
    found = secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"),
    )


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids and back as bytes, both as digests."""
    ranks = load_ranks()
    both = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    models = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, models).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that share four fifths of their two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the passages of 50 words that an earlier one has."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 between all vectors, counted, and the classes they make."""
    return link_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every document under the unigram model of the vocabulary's ranks."""
    return count_tokens(table(spark, sf_dir, "documents"), load_ranks())


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation as canonical JSON, with its place and what is wrong with its calls."""
    return format_chat(table(spark, sf_dir, "conversations"))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest id stays."""
    owned = exact_owners(table(spark, sf_dir, "documents"), largest=True)
    return owned.select("doc_id", F.col("owner").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, the cheapest edits that mend it, and the digest of what they give."""
    chunks = written(repair_conversations(damaged(table(spark, sf_dir, "conversations"))), "repaired")
    told = chunks.filter("chunk = 0").select("conv_id", *COUNTS, "audit", "n_chunks", "messages")
    # Nearly all conversations are one chunk, whose digest needs no second look.
    here = F.sha2(lines_of(), 256).alias("repaired_sha256")
    one = told.filter("n_chunks = 1").select("conv_id", *COUNTS, "audit", here)
    cut = chunks.filter("n_chunks > 1")
    hashes = digests(cut).select(F.col("conv_id").alias("id"), F.col("sha256").alias("repaired_sha256"))
    many = told.filter("n_chunks > 1").join(hashes, F.col("conv_id").eqNullSafe(F.col("id")))
    return one.unionByName(many.select("conv_id", *COUNTS, "audit", "repaired_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, a seventh of the labels moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("id") % 50 == 0)
