"""State: upserts, retention, admission, runs and table round trips."""

from datetime import datetime

from pyspark.sql import functions as F

from driftloom import schemas
from driftloom.functions import text as X
from driftloom.operators import coverage as C
from driftloom.operators import reports as R
from driftloom.operators import state as S
from driftloom.plans import trends as T
from driftloom.session import scratch_path
from driftloom.sources import tables as B

OBSERVED = "entity_id string, platform string, item_id string, item_text string, seen_at string, seq long"


def observed(spark, *rows):
    return spark.createDataFrame(list(rows), OBSERVED).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


def test_upsert_keeps_first_text(spark):
    first = S.upsert_items(None, observed(spark, ("e", "x", "1", "old", "2024-01-01", 1)))
    both = S.upsert_items(first, observed(spark, ("e", "x", "1", "new", "2024-01-05", 2), ("e", "y", "1", "other", "2024-01-05", 3)))
    rows = {r.platform: r for r in both.collect()}
    assert rows["x"].item_text == "old" and rows["x"].first_seen_at == datetime(2024, 1, 1)
    assert rows["x"].last_seen_at == datetime(2024, 1, 5) and rows["y"].item_text == "other"


def test_new_counts_rows_and_distinct(spark):
    obs = observed(spark, ("e", "x", "1", "t", "2024-01-01", 1), ("e", "x", "1", "t", "2024-01-01", 2), ("e", "y", "1", "t", "2024-01-01", 3))
    known = S.upsert_items(None, observed(spark, ("e", "y", "1", "t", "2023-01-01", 0)))
    assert [tuple(r) for r in S.new_item_counts(obs, known, ["platform"]).collect()] == [("x", 2, 1)]


def test_prune_keeps_latest_however_old(spark):
    rows = [(1, "a", "blog", "h", "t", "2020-01-01"), (2, "a", "blog", "h", "t", "2020-02-01"), (3, "b", "blog", "h", "t", "2024-01-30"),
            (4, "b", "blog", "h", "t", "2020-01-01")]
    df = spark.createDataFrame(rows, "seq long, entity_id string, page_type string, content_hash string, content_text string, checked_at string")
    df = df.withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))
    kept = {r.seq for r in S.prune_snapshots(df, datetime(2024, 2, 1)).collect()}
    assert kept == {2, 3, 4}
    items = S.upsert_items(None, observed(spark, ("e", "x", "1", "t", "2020-01-01", 1)))
    report = {r.table_name: r.pruned for r in S.prune_report(df, items, datetime(2024, 2, 1)).collect()}
    assert report == {"snapshots": 1, "items": 1}


def test_admission_counts_successes_only(spark):
    rows = [("e", "2024-01-01", i, i % 2 == 0) for i in range(10)] + [("e", "2024-02-01", 20, True)]
    log = spark.createDataFrame(rows, "endpoint string, ts string, seq long, success boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = [r.seq for r in S.admit(log, limit=3, width=4).filter("admitted").orderBy("seq").collect()]
    assert out == [0, 1, 2, 3, 4, 20]


def test_history_and_usage(spark):
    runs = spark.createDataFrame([(i, "s") for i in range(30)], "run_id long, status string")
    log = spark.createDataFrame([(29, "success"), (29, "error"), (29, "success"), (3, "error")], "run_id long, status string")
    out = T.run_history(runs, log).collect()
    assert len(out) == 20 and tuple(out[0]) == (29, "s", 2, 1) and out[1].error_count == 0
    usage = spark.createDataFrame([("a", "2024-01", 5)], "endpoint string, month string, request_count long")
    assert T.usage(usage, datetime(2024, 1, 9), "a").first().request_count == 5
    assert T.usage(usage, datetime(2024, 2, 9), "a").first().request_count == 0


def test_changed_texts_stand_beside_the_stored_ones(spark):
    schema = "seq long, entity_id long, page_type string, content_text string"
    stored = spark.createDataFrame([(1, 1, "blog", "old"), (2, 1, "blog", "newer"), (3, 2, "blog", "same")], schema)
    known = S.page_state_of(stored.withColumn("content_hash", X.content_hash(F.col("content_text"))))
    orphan = spark.createDataFrame([(9, "blog", 0, "gone")], "entity_id long, page_type string, seq long, content_hash string")
    captures = spark.createDataFrame(
        [(11, 1, "blog", "third"), (12, 1, "blog", "third "), (13, 1, "blog", "fourth"), (14, 2, "blog", "same"), (15, 3, "blog", "first"),
         (16, 3, "blog", ""), (17, 3, "blog", "second"), (18, 9, "blog", "x")], schema)
    for width in (2, 1000):
        changes = S.detect_changes(captures, known.unionByName(orphan.select(known.columns)), width)
        rows = S.changed_texts(changes, captures, stored, width).select("seq", "old_seq", "old_text", "new_text").collect()
        assert sorted(map(tuple, rows)) == [
            (11, 2, "newer", "third"), (13, 11, "third", "fourth"), (17, 15, "first", "second"), (18, None, None, "x")]
    none = S.changed_texts(S.detect_changes(captures.limit(0)), captures.limit(0))
    assert none.count() == 0


def test_failed_entities_are_logged(spark):
    tried = spark.createDataFrame(
        [(7, 1, "", 1.5), (7, 2, "timeout", 2.0), (7, 3, None, None)], "run_id long, entity_id long, error string, duration_seconds double")
    metrics = spark.createDataFrame([(1, 4, 5, 6), (2, 1, 1, 1)], "entity_id long, new_ads_count long, new_posts_count long, pages_changed_count long")
    sources = spark.createDataFrame(
        [(e, [("reddit", "ok", None)]) for e in (1, 2)], "entity_id long, sources array<struct<source:string,status:string,note:string>>")
    rows = {r.entity_id: r for r in C.log_outcomes(tried, metrics, sources).collect()}
    assert rows[1].status == "success" and rows[1].error_message is None and rows[1].pages_changed_count == 6
    assert rows[1].sources_json == '{"status":{"reddit":"ok"},"notes":{}}'
    assert (rows[2].status, rows[2].error_message, rows[2].new_ads_count, rows[2].sources_json) == ("error", "timeout", 0, None)
    assert (rows[3].status, rows[3].new_posts_count, rows[3].sources_json, rows[3].duration_seconds) == ("success", 0, None, None)


def test_new_jobs_of_a_changed_careers_page(spark):
    rows = spark.createDataFrame(
        [("careers", ["Cook", "Clerk"]), ("careers", []), ("careers", None), ("blog", ["Post"])], "page_type string, items array<string>")
    told = [r[0] for r in rows.select(R.page_change_text(F.col("page_type"), F.col("items"))).collect()]
    plain = "• Content changed (summary unavailable)"
    assert told == [plain + "\n\n_New jobs:_ 2 new job posting(s): Cook, Clerk", plain, plain, plain]


def test_state_versions(spark):
    path = scratch_path(spark, "versions")
    assert B.read_state(spark, path) is None
    for n in range(4):
        B.commit_state(spark.range(n + 1), path)
    assert B.versions(spark, path)[-1] == 3 and B.read_state(spark, path).count() == 4
    assert B.read_state(spark, path, before=3).count() == 3
    B.commit_state(spark.range(9), path, version=3)
    assert B.read_state(spark, path).count() == 9


def test_unfinished_version_is_invisible(spark):
    path = scratch_path(spark, "half")
    B.commit_state(spark.range(2), path)
    spark.range(5).write.parquet(f"{path}/version=7/part")
    assert B.read_state(spark, path).count() == 2


def test_batch_append_is_repeatable(spark):
    path = scratch_path(spark, "append")
    for _ in range(2):
        B.append(spark.range(3), path, batch=0)
    B.append(spark.range(4), path, batch=1)
    assert spark.read.parquet(path).count() == 7


def test_evolved_schema(spark):
    path = scratch_path(spark, "evolved")
    old = spark.createDataFrame([("a", "success")], "entity_id string, status string")
    new = spark.createDataFrame([("b", "success", 4)], "entity_id string, status string, new_ads_count long")
    B.append(old, path)
    B.append(new, path)
    rows = {r.entity_id: r for r in B.read_evolved(spark, path, schemas.RUN_LOG, schemas.RUN_LOG_DEFAULTS).collect()}
    assert rows["a"].new_ads_count == 0 and rows["b"].new_ads_count == 4 and rows["a"].run_id is None


def test_scratch_tables_have_an_owner(spark):
    import os

    from driftloom.sources.tables import owned_tables, written

    with owned_tables(spark) as paths:
        assert written(spark.range(5), "mine").count() == 5
        assert len(paths) == 1 and os.path.isdir(paths[0])
    assert not os.path.exists(paths[0])
    assert written(spark.range(5), "free").count() == 5
