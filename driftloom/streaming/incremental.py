"""Structured Streaming jobs. Each micro-batch reuses the batch operators against versioned state.

All results of a batch go to folders named by the batch number, so a repeated batch replaces its own
output and the state it read; a lost executor costs a retry, never a duplicate. A batch reads the state of its own
keys only, and commits no other rows. Working per batch also lets a hot page or item use the skew-safe batch
plans instead of one state-store task.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftloom.functions import vocab as V
from driftloom.operators import state as S
from driftloom.operators.posts import dedup_first
from driftloom.sources.keyed import KeyedState
from driftloom.sources.tables import append, written


def _start(stream: DataFrame, root: str, step) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )



def stream_changes(stream: DataFrame, root: str) -> StreamingQuery:
    """Change detection over a stream of captures.

    Writes ``root/changes``, the texts to keep under ``root/snapshots`` and the last hash per page.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pages = KeyedState(spark, f"{root}/pages", S.PAGE_KEYS)
        known = pages.read(before=batch_id, only=batch)
        changes = S.detect_changes(batch, known)
        append(changes.drop("prev_hash"), f"{root}/changes", batch_id)
        written = spark.read.parquet(f"{root}/changes/batch={batch_id}")
        append(S.snapshots_to_append(written, batch), f"{root}/snapshots", batch_id)
        pages.commit(S.page_state_of(written), batch_id)

    return _start(stream, root, step)


def stream_items(stream: DataFrame, root: str, trend: bool = False) -> StreamingQuery:
    """Item upsert over a stream of sightings: ``root/new_items`` (the feed), ``root/items``, and the trend of the feed if wanted.

    The feed is the first sighting of every unknown item; sightings of one item collapse before the
    join with the known items. The trend is counted from the batch's own feed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items = KeyedState(spark, f"{root}/items", S.ITEM_KEYS)
        known = items.read(before=batch_id, only=batch)
        first = dedup_first(batch, S.ITEM_KEYS, ["seq"])
        fresh = first if known is None else S.new_items(first, known)
        append(fresh, f"{root}/new_items", batch_id)
        if trend:
            count_weeks(spark.read.parquet(f"{root}/new_items/batch={batch_id}"), root, batch_id)
        items.commit(S.upsert_items(known, batch), batch_id)

    return _start(stream, root, step)


def stream_new(stream: DataFrame, root: str, keep_days: int = V.ITEM_DAYS) -> StreamingQuery:
    """New-item feed that remembers an item for ``keep_days`` after it was last seen: ``root/new`` (keys and seq).

    The clock is the latest time of sighting of all batches. An item that is forgotten is new when it comes again; a
    sighting older than what was remembered before its batch is late: it goes to ``root/late`` and is neither new nor
    remembered. Sightings without a time are taken to be of now. What is remembered is a key and a time; what is
    forgotten leaves the state as its buckets are rewritten. Sightings of one item meet before they move.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        seen = KeyedState(batch.sparkSession, f"{root}/seen", S.ITEM_KEYS)
        before = _time(seen.note(batch_id).get("clock"))
        now = max([t for t in (before, batch.agg(F.max("seen_at")).first()[0]) if t is not None], default=None)
        since = None if before is None else before - timedelta(days=keep_days)
        at = F.coalesce("seen_at", _at(now))
        late = F.lit(False) if since is None else at < _at(since)
        overdue = batch.filter(late)
        if since is not None and not overdue.isEmpty():
            append(overdue, f"{root}/late", batch_id)
        here = batch.filter(~late).groupBy(*S.ITEM_KEYS).agg(F.min("seq").alias("seq"), F.max(at).alias("last_seen_at"))
        here = written(here, "sightings")
        known = seen.read(before=batch_id, only=here)
        held = None if known is None else known.filter(F.col("last_seen_at") >= _at(since))
        fresh = here if held is None else S.new_items(here, held)
        append(fresh.select("seq", *S.ITEM_KEYS), f"{root}/new", batch_id)
        times = here.drop("seq") if held is None else here.drop("seq").unionByName(held)
        merged = times.groupBy(*S.ITEM_KEYS).agg(F.max("last_seen_at").alias("last_seen_at"))
        live = None if now is None else F.col("last_seen_at") >= _at(now - timedelta(days=keep_days))
        seen.commit(merged, batch_id, {"clock": now and now.isoformat()}, live)

    return _start(stream, root, step)


def _at(time: datetime | None) -> Column:
    return F.lit(time and time.isoformat(sep=" ")).cast("timestamp_ntz")


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


TREND_KEYS = ["week_start", "entity_id", "platform"]


def weekly_counts(rows: DataFrame, at: str = "seen_at") -> DataFrame:
    """Counts per Monday-based week, entity and platform; partial counts combine before the shuffle."""
    week = F.to_date(F.date_trunc("week", F.col(at))).alias("week_start")
    return rows.groupBy(week, "entity_id", "platform").agg(F.count(F.lit(1)).alias("new_count"))


def _closed(clock: datetime | None, delay_days: int) -> date | None:
    """The first week that is still open, given the latest time seen."""
    if clock is None:
        return None
    mark = clock - timedelta(days=delay_days)
    return mark.date() - timedelta(days=mark.weekday())


def _added(*counts: DataFrame | None) -> DataFrame:
    parts = [c.select(*TREND_KEYS, "new_count") for c in counts if c is not None]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*TREND_KEYS).agg(F.sum("new_count").alias("new_count"))


def count_weeks(rows: DataFrame, root: str, batch_id: int, at: str = "seen_at", delay_days: int = 14) -> None:
    """Adds a batch to the weekly counts: one row for each open week and group, in keyed state.

    A week is closed once the latest time seen is ``delay_days`` past its end. Closed weeks are written once, one row a
    group, to ``root/closed`` by week, and leave the state. Rows of a closed week are late, and so are rows without a
    time (their week is null): they are counted apart, in ``root/late_weeks``. The state's manifest holds the clock, so
    readers see a batch, and the weeks it closes, all at once; a repeated batch replaces itself.
    """
    spark = rows.sparkSession
    weeks, late = (KeyedState(spark, f"{root}/{name}", TREND_KEYS[:]) for name in ("open_weeks", "late_weeks"))
    before = _time(weeks.note(batch_id).get("clock"))
    counts = written(weekly_counts(rows, at), "week-counts")
    newest = rows.agg(F.max(at)).first()[0]
    now = max([t for t in (before, newest) if t is not None], default=None)
    start, after = _closed(before, delay_days), _closed(now, delay_days)
    in_time = F.col("week_start").isNotNull() & (F.lit(True) if start is None else F.col("week_start") >= F.lit(start))
    fresh, overdue = counts.filter(in_time), counts.filter(~in_time)
    if after is not None and after != start:
        known = weeks.read(before=batch_id)
        held = known if known is None or start is None else known.filter(F.col("week_start") >= F.lit(start))
        done = _added(fresh, held).filter(F.col("week_start") < F.lit(after))
        done.repartition("week_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").parquet(f"{root}/closed")
    named = overdue.withColumn("week_start", F.coalesce("week_start", F.lit(NO_WEEK)))
    if not overdue.isEmpty():
        late.commit(_added(named, late.read(before=batch_id, only=named)), batch_id)
    live = None if after is None else F.col("week_start") >= F.lit(after)
    weeks.commit(_added(fresh, weeks.read(before=batch_id, only=fresh)), batch_id, {"clock": now and now.isoformat(), "open": after and after.isoformat()}, live)


#: Stands for the week of rows without a time, as keys are never null.
NO_WEEK = date(1900, 1, 1)


def stream_trend(stream: DataFrame, root: str, at: str = "seen_at", delay_days: int = 14) -> StreamingQuery:
    """Weekly counts kept current, see :func:`count_weeks`."""
    return _start(stream, root, lambda batch, batch_id: count_weeks(batch, root, batch_id, at, delay_days))


def current_trend(spark: SparkSession, root: str, late: bool = True) -> DataFrame:
    """The count of every week and group: open and closed weeks, and late rows unless they are not wanted."""
    weeks = KeyedState(spark, f"{root}/open_weeks", TREND_KEYS)
    held, first = weeks.read(), weeks.note().get("open")
    if held is None:
        return spark.createDataFrame([], "week_start date, entity_id string, platform string, new_count bigint")
    parts = [held if first is None else held.filter(F.col("week_start") >= F.lit(date.fromisoformat(first)))]
    if first is not None:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
        parts.append(spark.read.schema(fields).parquet(f"{root}/closed").filter(F.col("week_start") < F.lit(date.fromisoformat(first))))
    if late:
        overdue = KeyedState(spark, f"{root}/late_weeks", TREND_KEYS).read()
        if overdue is not None:
            parts.append(overdue.withColumn("week_start", F.nullif("week_start", F.lit(NO_WEEK))))
    return _added(*parts)
