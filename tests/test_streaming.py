"""Micro-batches give what one batch gives."""

import os
import time

import pytest
from pyspark.sql import functions as F

from driftloom.operators import state as S
from driftloom.plans.adapters import view
from driftloom.session import scratch_path
from driftloom.sources.keyed import KeyedState
from driftloom.streaming import incremental as N

SF = "/root/testdata/sf0.001"


def in_batches(spark, df, path, cuts=(300, 800)):
    """Three files of increasing sequence numbers, and a stream that reads one per batch."""
    edges = [-1, *cuts, 1 << 40]
    for low, high in zip(edges, edges[1:]):
        df.filter((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def items(spark):
    return view(spark, SF, "fx_items")


def test_changes(spark):
    captures = view(spark, SF, "fx_captures")
    root = scratch_path(spark, "changes")
    stream = in_batches(spark, captures, f"{root}/in")
    N.stream_changes(stream, root).awaitTermination()
    out = spark.read.parquet(f"{root}/changes")
    assert out.select("batch").distinct().count() == 3
    assert same(S.detect_changes(captures).select("seq", "verdict"), out)
    N.stream_changes(stream, root).awaitTermination()  # nothing new: nothing changes
    assert spark.read.parquet(f"{root}/changes").count() == captures.count()


def test_items_and_feed(spark, items):
    root = scratch_path(spark, "items")
    N.stream_items(in_batches(spark, items, f"{root}/in"), root).awaitTermination()
    assert same(S.upsert_items(None, items), KeyedState(spark, f"{root}/items", S.ITEM_KEYS).read())
    feed = spark.read.parquet(f"{root}/new_items")
    first = items.groupBy(*S.ITEM_KEYS).agg(F.min("seq").alias("seq"))
    assert same(first, feed)


def weeks_of(rows):
    monday = F.to_date(F.date_trunc("week", "seen_at")).alias("week_start")
    return rows.groupBy(monday, "entity_id", "platform").agg(F.count("*").alias("new_count"))


def test_trend_keeps_late_rows_and_replays(spark, items):
    root = scratch_path(spark, "trend")
    late = items.withColumn("seen_at", F.when(F.col("seq") > 800, F.expr("seen_at - interval 60 days")).otherwise(F.col("seen_at")))
    stream = in_batches(spark, late, f"{root}/in")
    N.stream_trend(stream, f"{root}/weeks").awaitTermination()
    assert same(weeks_of(late), N.current_trend(spark, f"{root}/weeks"))
    assert same(weeks_of(late.filter("seq <= 800")), N.current_trend(spark, f"{root}/weeks", late=False))
    N.count_weeks(late.filter("seq > 800"), f"{root}/weeks", 2)  # the last batch once more
    assert same(weeks_of(late), N.current_trend(spark, f"{root}/weeks"))


def test_closed_weeks_are_one_row_each_and_leave_the_state(spark):
    root = scratch_path(spark, "closing")
    rows = spark.range(0, 400).selectExpr(
        "cast(id % 3 as string) as entity_id", "'x' as platform", "id as seq",
        "if(id = 399, null, timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id / 4 as int))) as seen_at",
    )
    folders = set()
    for n, low in enumerate(range(0, 400, 50)):
        N.count_weeks(rows.filter((F.col("seq") >= low) & (F.col("seq") < low + 50)), root, n)
        state = KeyedState(spark, f"{root}/open_weeks", N.TREND_KEYS)
        first = state.note()["open"]
        assert state.read().filter(F.col("week_start") >= F.lit(first).cast("date")).select("week_start").distinct().count() <= 4
        folders.add(len(os.listdir(f"{root}/open_weeks/data")))
    assert same(weeks_of(rows), N.current_trend(spark, root))
    closed = spark.read.parquet(f"{root}/closed")
    assert closed.count() == closed.select(*N.TREND_KEYS).distinct().count() > 20
    assert state.read().count() < 40 and max(folders) < 12  # most closed weeks have gone from the state, and folders do not add up


def test_new_items_are_forgotten_and_late_ones_told(spark):
    root = scratch_path(spark, "forget")
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({})"

    def batch(*rows):
        rows = spark.createDataFrame([(f"i{k}", day, seq) for k, day, seq in rows], "item_id string, day int, seq long")
        return rows.selectExpr("'e' as entity_id", "'x' as platform", "item_id", "seq", f"if(day is null, null, {at.format('day')}) as seen_at")

    path = f"{root}/in"
    batches = [
        batch((1, 0, 1), (1, 5, 2), (2, 0, 3)),  # 1 is seen again on day 5
        batch((3, 22, 4), (2, 6, 5), (None, None, 6)),
        batch((1, 22, 7), (2, 25, 8), (9, 2, 9)),  # 1 (day 5) is forgotten, 2 (day 6) is not; 9 is late
        batch(*[(100 + i, 60 + i, 10 + i) for i in range(40)]),
        batch(*[(200 + i, 120 + i, 60 + i) for i in range(60)]),
    ]
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(path)
        N.stream_new(spark.readStream.schema(rows.schema).parquet(path), root, keep_days=16).awaitTermination()
    new = [r.seq for r in spark.read.parquet(f"{root}/new").filter("seq < 10").orderBy("seq").collect()]
    assert new == [1, 3, 4, 6, 7] and [r.seq for r in spark.read.parquet(f"{root}/late").collect()] == [9]
    state = KeyedState(spark, f"{root}/seen", S.ITEM_KEYS)
    assert state.read().count() < 80  # of 104 items, those that were forgotten have left rewritten buckets


def test_streams_read_rows_without_id(spark, tmp_path):
    from driftloom.plans.catalog import stream_events

    spark.createDataFrame([(1, "a"), (None, "b"), (9, "c")], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    root = str(tmp_path / "out")

    def start(events):
        return events.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    stream_events(spark, str(tmp_path), start)
    assert sorted(r["props"] for r in spark.read.parquet(f"{root}/rows").collect()) == ["a", "b", "c"]
