"""The corpus pipeline: stages over ``documents``, each one written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last
returns token ids. Rows without doc_id stay until a stage has a reason to drop them; columns that the
stages do not know are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import langid
from driftloom.llm.bpe import decode, encode, load_ranks
from driftloom.llm.common import table, written
from driftloom.llm.minhash import near_duplicates
from driftloom.llm.mixing import mix
from driftloom.llm.secrets import redact, secret_spans
from driftloom.sources.tables import owned_tables


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without text or letters, or between two languages, go."""
    models = langid.fit(docs)
    # The text stands once in a row, beside what else the row has.
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    told = langid.predict(docs.select(rest, "text"), models).filter(~F.col("rejected"))
    return told.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest doc_id.

    Of several rows with that doc_id that are kept one stays, that with the smallest text hash. Rows without doc_id are in
    no group and stay.
    """
    with owned_tables(spark):  # sketches and sets have done their work once this small table is there
        kept = near_duplicates(docs, size=5, percent=80, prints=True).filter("kept")
        chosen = written(kept.groupBy("doc_id").agg(F.min("print").alias("__print")), "kept-documents", keep=True)
    named = docs.filter("doc_id is not null").withColumn("__print", F.xxhash64("text"))
    stay = named.join(chosen, ["doc_id", "__print"], "left_semi").dropDuplicates(["doc_id", "__print"])
    return stay.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark, and n_chars set anew where the text changed."""
    found = secret_spans(docs.select(F.struct("*").alias("row"), "text"), keep=["row"])
    text = redact(F.col("row.text"), F.col("secrets"))
    clean = found.select("row", "secrets", text.alias("text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("secrets") > 0, changed).otherwise(columns["n_chars"])
    return clean.select(*[v.alias(k) for k, v in columns.items()])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; those it does not take go.

    Rows alike in id and text are copied alike.
    """
    mixed = mix(docs, table(spark, sf_dir, "labels")).filter("copies > 0")
    copies = mixed.groupBy("doc_id", "print").agg(F.max("copies").alias("__copies"))
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), "__copies")
    met = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__print")))
    return met.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(*[docs[c] for c in docs.columns])


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the bytes that the ids decode to."""
    ranks = load_ranks()
    both = decode(encode(docs, ranks), ranks)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("mix_sources", mixed_sources),
    ("bpe_tokens", as_tokens),
]

#: Compression, register likelihoods and merges are not SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
