"""Entity registry, page captures, forum listings and social payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom import schemas
from driftloom.functions import vocab as V
from driftloom.functions.ids import content_id
from driftloom.functions.text import first_present, let, strip, truncate_note


def string_list(arr: Column) -> Column:
    """Trimmed, non-blank entries; a missing list is empty."""
    kept = F.filter(F.transform(arr.cast("array<string>"), strip), lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def load_entities(df: DataFrame, list_columns: list[str]) -> DataFrame:
    """Entities with a name and a website; ids as text, list columns cleaned."""
    present = (F.col("name") != "") & (F.col("website") != "")
    cleaned = {c: string_list(F.col(c)) for c in list_columns}
    return df.filter(present).withColumns({"entity_id": F.col("entity_id").cast("string"), **cleaned})


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page captures from Parquet or JSON files, with an explicit schema."""
    return spark.read.schema(schemas.CAPTURES).format(fmt).load(path)


def has_error(error: Column) -> Column:
    """Whether a capture failed: it names an error, and an empty one is none."""
    return F.coalesce(error != "", F.lit(False))


def capture_status(df: DataFrame) -> DataFrame:
    """Whether each capture succeeded, and why not."""
    failed = has_error(F.col("error"))
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return df.withColumns(
        {
            "status": F.when(failed | empty, F.lit("failed")).otherwise(F.lit("ok")),
            "note": F.when(failed, truncate_note(F.col("error"))).when(empty, F.lit("empty response")),
        }
    )


def parse_listing(df: DataFrame, json_col: str) -> DataFrame:
    """Posts of forum-listing payloads, in listing order; malformed payloads yield nothing."""
    parsed = F.from_json(json_col, schemas.LISTING)["data"]["children"]
    rest = [c for c in df.columns if c != json_col]
    rows = df.select(*rest, F.posexplode(parsed).alias("pos", "child"))
    post = F.col("child")["data"]
    return rows.select(
        *rest, "pos",
        post["id"].alias("post_id"), post["title"].alias("title"), post["selftext"].alias("raw_body"),
        post["subreddit"].alias("channel"), post["permalink"].alias("permalink"),
        F.coalesce(post["created_utc"], F.lit(0.0)).alias("created_utc"),
    )


def _present(value: Column) -> Column:
    """JSON text that counts as present: not null, empty, zero or false."""
    return F.when(~value.rlike(r"^(?:\[\s*\]|\{\s*\}|0|false|)$"), value)


def _whole_number(text: Column) -> Column:
    """Plain digits as they are, however many of a bigint's; null for all else."""
    return F.when(~text.contains(".") & ~text.contains("+"), text.try_cast("bigint"))


def counter_value(text: Column) -> Column:
    """A counter as a whole number: plain, with a fraction, or shortened by K, M or B; null when it is no number."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*([KkMmBb]?)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"([KkMmBb])\s*$", 1))
    times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    rounded = F.round(F.replace(number, F.lit(","), F.lit("")).try_cast("double") * times).try_cast("bigint")
    return F.coalesce(_whole_number(text), F.when(number != "", rounded))


def normalize_payload(df: DataFrame, payload: str, source: Column, is_owned: Column) -> DataFrame:
    """One row per post of a social payload, whichever of the four list fields it uses.

    ``engagement_raw`` has every counter that is not null, as text; ``engagement`` those that are numbers.
    """
    lists = F.from_json(F.when(F.col(payload).rlike(r"^\s*\{"), F.col(payload)), ", ".join(f"{k} string" for k in V.PAYLOAD_LISTS))
    raw = let(lists, lambda found: F.coalesce(*[_present(found[k]) for k in V.PAYLOAD_LISTS]))
    items = F.filter(F.from_json("_listed", "array<string>"), lambda x: x.startswith("{"))
    rest = [c for c in df.columns if c != payload]
    listed = df.select(*rest, source.alias("source"), is_owned.alias("is_owned"), raw.alias("_listed")).filter(F.col("_listed").startswith("["))
    rows = listed.select(*rest, "source", "is_owned", F.posexplode(items).alias("pos", "_item"))
    texts = ["title", "snippet", "text", "body", "url", "author", "username", "date"]
    schema = ", ".join([f"{t} string" for t in texts] + [f"{k} string" for k in V.ENGAGEMENT_KEYS])
    item = F.col("_post")
    blank = F.lit("")
    counters = F.create_map(*[x for k in V.ENGAGEMENT_KEYS for x in (F.lit(k), item[k])])
    counters = F.map_filter(counters, lambda _, v: v.isNotNull())
    parsed = rows.withColumn("_post", F.from_json("_item", schema)).select(
        *rest, "source", "is_owned", "pos",
        F.coalesce(item["title"], blank).alias("title"),
        F.coalesce(first_present(item["snippet"], item["text"], item["body"]), blank).alias("text"),
        F.coalesce(item["url"], blank).alias("url"),
        F.coalesce(first_present(item["author"], item["username"]), blank).alias("author"),
        F.coalesce(item["date"], blank).alias("date"),
        F.map_filter(F.transform_values(counters, lambda _, v: counter_value(v)), lambda _, v: v.isNotNull()).alias("engagement"),
        counters.alias("engagement_raw"),
    )
    return parsed.withColumn("post_id", content_id(F.col("url"), F.col("title"), F.col("text")))


def endpoint_dim(spark: SparkSession) -> DataFrame:
    """The eight request endpoints with their source and ownership; a fixed table."""
    return spark.createDataFrame(V.ENDPOINTS, "endpoint string, source string, is_owned boolean")


def with_endpoint(df: DataFrame) -> DataFrame:
    """Source and ownership of each row's endpoint."""
    return df.join(F.broadcast(endpoint_dim(df.sparkSession)), "endpoint", "left")
