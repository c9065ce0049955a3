"""Segmented windows equal plain ones, also for a hot key and tiny segments."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.operators import reports as R
from driftloom.operators import state as S
from driftloom.operators.segments import lag_over, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string"))
    return spark.range(0, 3000).select(
        F.col("id").alias("seq"), key.alias("k"), (F.col("id") * 7919 % 5).cast("string").alias("v"), (F.col("id") % 11).alias("n")
    )


@pytest.mark.parametrize("width", [100, 700, 1 << 20])
def test_lag(rows, width):
    plain = rows.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("seq")))
    ours = lag_over(rows, ["k"], "seq", "v", "p", width).select(*plain.columns)
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


@pytest.mark.parametrize("width", [150, 1 << 20])
@pytest.mark.parametrize("exclusive", [True, False])
def test_running_sum(rows, width, exclusive):
    w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    plain = rows.withColumn("s", F.coalesce(F.sum("n").over(w), F.lit(0)))
    ours = running_sum(rows, ["k"], "seq", F.col("n"), "s", exclusive, width).select(*plain.columns)
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


def test_changes_do_not_depend_on_width(spark):
    captures = spark.range(0, 2000).select(
        F.col("id").alias("seq"), (F.col("id") % 2).alias("entity_id"), F.lit("blog").alias("page_type"),
        F.when(F.col("id") % 13 == 0, F.lit("")).otherwise((F.col("id") * 31 % 3).cast("string")).alias("content_text"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("checked_at"),
    )
    wide = S.detect_changes(captures).select("seq", "verdict")
    narrow = S.detect_changes(captures, width=300).select("seq", "verdict")
    assert wide.exceptAll(narrow).count() == 0
    assert wide.filter("verdict = 'first'").count() == 2


def test_prefix_budget_is_greedy(spark):
    rows = [(i, "a" if i % 3 else "b", (i * 37) % 19 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, k string, n long")
    got = {r.seq for r in R.prefix_budget(df, ["k"], "seq", F.col("n"), 200, width=64).collect()}
    want, used, closed = set(), {}, set()
    for seq, k, n in rows:
        if k in closed or used.get(k, 0) + n > 200:
            closed.add(k)
            continue
        used[k] = used.get(k, 0) + n
        want.add(seq)
    assert got == want


def test_sparse_numbers_and_a_hot_key_make_even_segments(rows):
    from driftloom.operators.segments import cut

    sparse = rows.withColumn("seq", F.col("seq") * (1 << 21))
    sizes = [r["count"] for r in cut(sparse, ["k"], "seq", 300).groupBy("_segment").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 900
    plain = sparse.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("seq")))
    ours = lag_over(sparse, ["k"], "seq", "v", "p", 300).select(*plain.columns)
    assert ours.exceptAll(plain).count() == 0
