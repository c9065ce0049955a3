"""Rows fetched by id: the same as a join, without moving the others, and without sorting texts."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import coverage as C
from driftloom.operators import fetch as L
from driftloom.operators import reports as R
from driftloom.operators import state as S
from driftloom.plans.adapters import view
from driftloom.session import scratch_path

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    path = scratch_path(spark, "texts")
    spark.range(20_000).selectExpr("id as seq", "if(id % 7 = 0, null, id % 5) as k", "repeat(sha2(string(id), 256), 4) as text").write.parquet(path)
    return spark.read.parquet(path)


def test_filter_lets_all_wanted_rows_pass_and_few_others(spark, texts):
    ids = L.written(texts.filter("seq % 10 = 3").select("seq"), "ids")
    may, rest = L.parted(texts, ids, ["seq"], few=0)
    assert may.filter("seq % 10 = 3").count() == 2000 and may.count() < 2000 * 1.05
    assert may.unionByName(rest).exceptAll(texts).count() == 0 and may.count() + rest.count() == 20_000
    assert L.parted(texts, ids, ["seq"])[1] is None


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_fetch_is_a_join(spark, texts, few):
    ids = texts.filter("seq % 10 = 3").select("seq", "k", (F.col("seq") + 1).alias("more"))
    got = L.fetch(texts, ids, ["k", "seq"], few)  # null keys are equal
    want = texts.filter("seq % 10 = 3").withColumn("more", F.col("seq") + 1)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 2000


def test_texts_that_are_not_wanted_are_in_no_exchange(spark, texts):
    ids = texts.filter("seq % 100 = 3").select("seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.fetch(texts, ids, ["seq"], few=0)
        got.write.format("noop").mode("overwrite").save()
        got.collect()
        plan, moved = got._jdf.queryExecution().executedPlan(), []

        def walk(node):
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                return walk(node.executedPlan())
            if name.endswith("QueryStage"):
                return walk(node.plan())
            if name == "Exchange" and "text" in node.output().toString():
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plan)
        assert moved and sum(moved) < 200 * 1.1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_text_is_sorted_for_the_latest_row(spark):
    captures = view(spark, SF, "fx_captures")
    items = view(spark, SF, "fx_items")
    known = S.upsert_items(None, items.filter("seq < 500"))
    plans = [
        S.latest_by(captures, S.PAGE_KEYS, "seq"), S.latest_by(view(spark, SF, "fx_summaries"), ["entity_id", "summary_type"], "created_at", "id"),
        S.upsert_items(known, items), R.entity_report(view(spark, SF, "fx_summaries"), ["run_id", "entity_id"]),
        C.source_status(view(spark, SF, "fx_source_status"), ["entity_id"]), S.snapshots_to_append(S.detect_changes(captures), captures),
    ]
    for df in plans:
        assert "SortAggregate" not in plan_of(df)


def test_latest_row_of_null_orders_and_ties(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 7, "y"), ("a", None, 9, "z"), ("b", None, 1, "only"), ("b", None, 2, "last")]
    df = spark.createDataFrame(rows, "k string, at int, seq int, text string")
    assert sorted((r.k, r.text) for r in S.latest_by(df, ["k"], "at", "seq").collect()) == [("a", "y"), ("b", "last")]


def test_known_items_that_are_not_seen_again_stay(spark, monkeypatch):
    monkeypatch.setattr(S, "parted", lambda rows, ids, key: L.parted(rows, ids, key, few=0))
    items = view(spark, SF, "fx_items")
    known = S.upsert_items(None, items.filter("seq < 500"))
    both = S.upsert_items(known, items.filter("seq >= 500"))
    whole = S.upsert_items(None, items)
    assert both.exceptAll(whole).count() == 0 and whole.exceptAll(both).count() == 0


def test_filter_pages_are_whole_and_not_looked_up_word_by_word(spark):
    from driftloom.operators.fetch import _PAGE_WORDS, _word_and_bits, bloom_pages

    ids = spark.range(3000).withColumnRenamed("id", "seq")
    pages, size = bloom_pages(ids, ["seq"], 3000)
    plan = pages._jdf.queryExecution().analyzed().toString()
    assert "map_from_entries" not in plan and "element_at" not in plan
    want = [0] * size
    for r in ids.select(*[c.alias(n) for c, n in zip(_word_and_bits(["seq"], size), ("w", "b"), strict=True)]).collect():
        want[r.w] |= r.b
    got = {r["_page"]: r["_words"] for r in pages.collect()}
    assert set(got) == {i // _PAGE_WORDS for i, b in enumerate(want) if b}
    assert all(words == want[p * _PAGE_WORDS : (p + 1) * _PAGE_WORDS] for p, words in got.items())
