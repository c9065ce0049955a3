"""Snapshots by month: retention by dropping partitions."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftloom.operators import state as S
from driftloom.session import scratch_path
from driftloom.sources.snapshots import SnapshotStore

SCHEMA = "seq long, entity_id string, page_type string, content_text string, checked_at timestamp_ntz"
AS_OF = datetime(2024, 6, 20)


def captures(spark, seed, n=400):
    """Rows in order of time; some pages are never seen again after a while."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        page = rnd.randrange(40 if i < n // 2 else 12)
        rows.append((i, f"e{page % 9}", f"p{page // 9}", f"text {i}", datetime(2024, 1, 1) + timedelta(hours=i * 10)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("seed,unit,days", [(1, "month", 30), (2, "day", 45)])
def test_prune_is_that_of_a_whole_table(spark, seed, unit, days):
    rows, df = captures(spark, seed)
    path = scratch_path(spark, "store")
    store = SnapshotStore(spark, path, unit=unit)
    assert store.read() is None and store.prune(AS_OF, days) == 0
    for low in range(0, len(rows), 100):
        store.append(df.filter((F.col("seq") >= low) & (F.col("seq") < low + 100)))
    assert store.count() == len(rows) and store.read().count() == len(rows)
    wanted = {r.seq for r in S.prune_snapshots(df, AS_OF, days).select("seq").collect()}
    assert store.prune(AS_OF, days) == len(rows) - len(wanted)
    assert {r.seq for r in store.read().collect()} == wanted and store.count() == len(wanted)
    assert {tuple(r) for r in store.read().collect()} <= set(rows)
    # A page that comes back loses its carried row, and a month later more goes; the whole table says the same.
    more = spark.createDataFrame([(1000, rows[0][1], rows[0][2], "again", datetime(2024, 6, 19))], SCHEMA)
    store.append(more)
    later = AS_OF + timedelta(days=25)
    wanted = {r.seq for r in S.prune_snapshots(df.unionByName(more), later, days).select("seq").collect()}
    store.prune(later, days)
    assert {r.seq for r in store.read().collect()} == wanted


def test_recent_months_are_not_touched(spark):
    rows, df = captures(spark, 3)
    path = scratch_path(spark, "store")
    store = SnapshotStore(spark, path, keep=1)
    store.append(df)
    before = files(f"{path}/data")
    store.prune(AS_OF, 30)
    after = files(f"{path}/data")
    recent = {f for f in before if "_part=2024-06" in f}
    assert recent and all(after.get(f) == before[f] for f in recent)
    assert not [f for f in after if "_part=2024-0" in f and f.split("_part=")[1][:7] < "2024-05"]
    # What a killed write left is not seen, and goes.
    df.write.parquet(f"{path}/data/_write=dead/_part=2024-06")
    n = store.count()
    assert store.read().count() == n
    store.append(df.filter("seq < 0"))
    assert not os.path.exists(f"{path}/data/_write=dead") and store.read().count() == n


def test_versions_and_rows_without_a_time(spark):
    _, df = captures(spark, 4, 20)
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        store.append(df, version=0)
    assert store.count() == 20
    undated = df.limit(1).withColumns({"seq": F.lit(-1).cast("bigint"), "checked_at": F.lit(None).cast("timestamp_ntz"), "extra": F.lit(7)})
    store.append(undated)
    store.prune(datetime(2030, 1, 1), 30)
    left = store.read().collect()
    assert sum(r.seq == -1 for r in left) == 1 and {r.extra for r in left} == {None, 7}
    pages = df.select("entity_id", "page_type").distinct().count()
    assert len(left) == pages + 1
