"""Hard negatives against all scores, worked out one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm.hardneg import Bucket, LEAST, MOST, mine_hard_negatives, pack

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5):
    used = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in used:
        if i % every:
            continue
        scored = [
            (-min(max(sum(a * b for a, b in zip(v, w, strict=True)), LEAST), MOST), j, other) for j, other, w in used if j != i and len(v) == len(w)
        ]
        scored.sort()
        for p, j, other in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(hard, 1)]
    return sorted(out)


def random_rows(seed, n=240):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(n):
        size = float(rng.choice([0.1, 1, 1, 3]))
        v = (centres[rng.integers(6)] + rng.standard_normal(8) * rng.choice([0.05, 0.5])) * size / 3
        rows.append((int(i), [float(x) for x in v], int(rng.choice([0, 0, 0, 1, 2, -4]))))
    rows += [(1000 + i, rows[10][1], 2) for i in range(30)] + [rows[5], rows[20], rows[20]]
    rows += [(2000, None, 1), (2005, [1.0, None] + [0.0] * 6, 0), (2010, [float("nan")] * 8, 0), (2015, [float("inf")] * 8, 1), (2020, [0.5] * 8, None)]
    rows += [(None, [0.5] * 8, 1), (2025, [0.0] * 8, 0), (2030, [0.0] * 8, 1), (2035, [], 0), (2036, [], 0), (2037, [], 1)]
    rows += [(2040 + i, [0.3, 0.4 + i / 100], i % 2) for i in range(12)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"bucket": 16, "chunk": 4, "lane": 2}])
def test_against_all_scores(spark, sizes):
    rows = random_rows(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, mine_hard_negatives(df, F.col("id") % 5 == 0, **sizes).collect()))
    assert got == brute(rows) and len(got) > 300


def test_scores_beyond_a_long(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 6, 7, 300]) for _ in range(3)], i % 2) for i in range(30)]
    got = sorted(map(tuple, mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, bucket=8).collect()))
    assert got == brute(rows)


def test_no_rows_one_label_and_other_columns(spark):
    df = spark.createDataFrame([(5, [1.0], 0, "x", 1), (6, [1.0], 0, "y", 2)], SCHEMA + ", chunk string, id int")
    assert mine_hard_negatives(df, F.col("id") % 5 == 0).count() == 0
    empty = mine_hard_negatives(df.limit(0), F.col("id") % 5 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_focus_ranges_keep_all_that_qualify_and_prune():
    rng = np.random.default_rng(7)
    data = np.floor(rng.standard_normal((500, 16)) * 100 + 300 * np.eye(16)[rng.integers(0, 16, 500)])
    size = np.sqrt((data**2).sum(axis=1))
    order = np.argsort((data / size[:, None]).T, axis=1, kind="stable").astype("<u2")
    kind, packed = pack(data)
    bucket = Bucket({"ids": np.arange(500).tobytes(), "kind": kind, "data": packed, "most": float(size.max()), "sorted": order.tobytes()})
    pruned = 0
    for i in range(0, 500, 10):
        exact = data @ data[i]
        for least in (0.5, 0.8, 0.95):
            want = np.flatnonzero(exact >= least * size[i] * size.max())
            found = bucket.candidates(data[i] / size[i], size[i], least * size[i] * size.max())
            assert found is None or set(want) <= set(found.tolist())
            pruned += 500 if found is None else 500 - len(found)
    assert pruned > 0.5 * 500 * 50 * 2
