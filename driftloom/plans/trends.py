"""History and trend queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.weeks import month_label, week_label
from driftloom.operators.state import cutoff


def _trend(df: DataFrame, at: str, by: list[str], out: str, since: Column) -> DataFrame:
    recent = df.filter(F.col(at) >= since)
    return recent.groupBy(week_label(F.col(at)).alias("week"), *by).agg(F.count(F.lit(1)).alias(out))


def item_trend(items: DataFrame, as_of: datetime, entity: str | None = None,
               platform: str | None = None, weeks: int = V.TREND_WEEKS) -> DataFrame:
    """Items first seen per week, entity and platform."""
    if entity is not None:
        items = items.filter(F.col("entity_id") == entity)
    if platform is not None:
        items = items.filter(F.col("platform") == platform)
    return _trend(items, "first_seen_at", ["entity_id", "platform"], "new_count", cutoff(as_of, weeks=weeks))


def change_trend(snapshots: DataFrame, as_of: datetime, entity: str | None = None,
                 weeks: int = V.TREND_WEEKS) -> DataFrame:
    """Stored page snapshots per week, entity and page type."""
    if entity is not None:
        snapshots = snapshots.filter(F.col("entity_id") == entity)
    return _trend(snapshots, "checked_at", ["entity_id", "page_type"], "change_count", cutoff(as_of, weeks=weeks))


def run_history(runs: DataFrame, log: DataFrame, n: int = 20) -> DataFrame:
    """The newest runs with their success and error counts.

    The newest ``n`` runs are at most ``n`` rows, so they are broadcast to the log; only the log
    rows of those runs are aggregated.
    """
    newest = runs.orderBy(F.desc("run_id")).limit(n)
    hits = log.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")
    counts = hits.groupBy("run_id").agg(
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
    )
    joined = newest.join(counts, "run_id", "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("success_count", "error_count")}
    ).orderBy(F.desc("run_id"))


def run_summaries(summaries: DataFrame, run_id: int) -> DataFrame:
    """Every summary of one run, in order."""
    return summaries.filter(F.col("run_id") == run_id).orderBy("id")


def last_run_summaries(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Summaries of the newest run with their text length."""
    newest = runs.agg(F.max("run_id").alias("run_id"))  # one row
    return summaries.join(F.broadcast(newest), "run_id").select(
        "id", "run_id", "entity_id", "summary_type", F.length("summary_text").alias("text_length")
    )


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(n)


def change_history(summaries: DataFrame, entity: str, summary_type: str) -> DataFrame:
    """One entity's summaries of one type, newest first."""
    wanted = (F.col("entity_id") == entity) & (F.col("summary_type") == summary_type)
    return summaries.filter(wanted).orderBy(F.desc("created_at"), F.desc("id"))


def summary_history(summaries: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` summaries of every entity and type."""
    w = W.partitionBy("entity_id", "summary_type").orderBy(F.desc("created_at"), F.desc("id"))
    return summaries.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def weekly_counts(items: DataFrame, n: int = 20) -> DataFrame:
    """New items per week and entity; the newest ``n`` groups."""
    grouped = items.groupBy(week_label(F.col("first_seen_at")).alias("week"), "entity_id").agg(
        F.count(F.lit(1)).alias("new_count")
    )
    return grouped.orderBy(F.desc("week"), "entity_id").limit(n)


def usage(counts: DataFrame, as_of: datetime, endpoint: str | None = None) -> DataFrame:
    """Requests used in the month of ``as_of``: every endpoint, or one (0 when it has none)."""
    this_month = counts.filter(F.col("month") == as_of.strftime("%Y-%m"))
    if endpoint is None:
        return this_month.select("endpoint", "request_count")
    one = this_month.filter(F.col("endpoint") == endpoint)
    return one.agg(F.coalesce(F.sum("request_count"), F.lit(0)).alias("request_count")).select(
        F.lit(endpoint).alias("endpoint"), "request_count"
    )


def recent_checks(captures: DataFrame, n: int = 10) -> DataFrame:
    return captures.select("entity_id", "page_type", "checked_at", "seq").orderBy(
        F.desc("checked_at"), F.desc("seq")
    ).limit(n)


def usage_line(log: DataFrame) -> DataFrame:
    """One line: ``endpoint=count`` in endpoint order, then the total."""
    counts = log.filter("success").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct("endpoint", F.format_string("%s=%d", "endpoint", "n").alias("text"))
    rolled = counts.agg(F.array_sort(F.collect_list(pair)).alias("pairs"), F.sum("n").alias("total"))
    text = F.concat(
        F.lit("API Direct usage: "),
        F.array_join(F.transform("pairs", lambda p: p["text"]), ", "),
        F.format_string(" (total=%d)", "total"),
    )
    empty = F.lit("API Direct: no requests made")
    return rolled.select(F.when(F.size("pairs") > 0, text).otherwise(empty).alias("usage_line"))


