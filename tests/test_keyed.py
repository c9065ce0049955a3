"""Keyed state: what commits write, what they read, and what remains of a write that was killed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from driftloom.session import scratch_path
from driftloom.sources.keyed import KeyedState


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_hundredth_of_the_keys_writes_little(spark):
    path = scratch_path(spark, "keyed")
    state = KeyedState(spark, path, ["k"])
    state.commit(spark.range(200_000).selectExpr("id as k", "sha2(string(id), 256) as v"))
    before = files(path)
    state.commit(spark.range(0, 200_000, 100).selectExpr("id as k", "sha2(string(-id), 256) as v"))
    new = {f: n for f, n in files(path).items() if f not in before}
    assert 0 < sum(new.values()) < 0.05 * sum(before.values())
    got = state.read()
    assert got.count() == 200_000
    assert got.filter("v = sha2(string(if(k % 100 = 0, -k, k)), 256)").count() == 200_000
    assert rows_of(state.read(only=spark.createDataFrame([(100,), (7,), (-1,)], "k long")).select("k")) == [(7,), (100,)]


@pytest.mark.parametrize("bucket_rows", [1 << 20, 1])
def test_many_commits_give_the_last_rows_and_write_in_proportion(spark, bucket_rows):
    rng, path, want = random.Random(2), scratch_path(spark, "keyed"), {}
    state = KeyedState(spark, path, ["a", "b"], bucket_rows=bucket_rows)
    manifests = []
    for n in range(7):
        batch = {(rng.randrange(30), str(rng.randrange(4))): n for _ in range(60 if n == 0 else 12)}
        want |= batch
        state.commit(spark.createDataFrame([(*k, v) for k, v in batch.items()], "a long, b string, v int"))
        manifests.append(state._manifest(n))
        assert rows_of(state.read()) == sorted((*k, v) for k, v in want.items())
    assert state.versions() == [5, 6]
    named = {w for m in manifests[-2:] for w, _ in m["base"].values()} | {w for m in manifests[-2:] for w in m["later"]}
    assert {f.removeprefix("_write=") for f in os.listdir(f"{path}/data")} == named
    rewritten = [w for m in manifests for w, _ in m["base"].values() if "-1-" in w]
    assert rewritten if bucket_rows > 1 else manifests[-1]["buckets"] > 16


def test_a_replayed_batch_replaces_itself(spark):
    state = KeyedState(spark, scratch_path(spark, "keyed"), ["k"])
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    state.commit(first, 0)
    state.commit(spark.createDataFrame([(2, "wrong"), (3, "wrong")], "k long, v string"), 1)
    assert rows_of(state.read(before=1)) == [(1, "a"), (2, "b")]
    state.commit(spark.createDataFrame([(2, "c")], "k long, v string"), 1)
    assert rows_of(state.read()) == [(1, "a"), (2, "c")] and state.versions() == [0, 1]


def test_a_write_killed_half_way_is_invisible_and_goes(spark):
    path = scratch_path(spark, "keyed")
    state = KeyedState(spark, path, ["k"])
    state.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))

    bad = spark.range(2).select(F.col("id").alias("k"), F.when(F.col("id") == 0, "x").otherwise(F.raise_error(F.lit("killed"))).alias("v"))
    with pytest.raises(Exception, match="killed"):
        state.commit(bad, 1)
    done = spark.createDataFrame([(1, "lost")], "k long, v string")
    state._write(done, 1, 0, 16, False)  # all rows written, and the manifest never
    open(f"{path}/manifests/draft-0", "w").write("{")
    assert rows_of(state.read()) == [(1, "a"), (2, "b")] and state.versions() == [0]
    state.commit(spark.createDataFrame([(2, "c")], "k long, v string"), 1)
    assert rows_of(state.read()) == [(1, "a"), (2, "c")]
    assert len(os.listdir(f"{path}/data")) == 2


def test_new_columns_and_no_rows(spark):
    state = KeyedState(spark, scratch_path(spark, "keyed"), ["k"])
    assert state.read() is None
    state.commit(spark.createDataFrame([], "k long, v string"))
    assert state.read().count() == 0
    state.commit(spark.createDataFrame([(1, "a")], "k long, v string"))
    state.commit(spark.createDataFrame([(2, "b", 5)], "k long, v string, `more of it` int"))
    assert rows_of(state.read().orderBy("k")) == [(1, "a", None), (2, "b", 5)]
