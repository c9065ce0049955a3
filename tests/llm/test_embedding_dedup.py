"""Near-duplicate vectors: what moves, sets that no task holds whole, and sketches that lose no link."""

from collections import Counter

import numpy as np
import pytest

from driftloom.llm import embdedup
from driftloom.llm.embdedup import link_vectors, may_link, sketch, units


def answer(ids, x, least=0.95):
    """(id, links, component, kept) of distinct ids, from all pairs."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= least
    label = np.array(ids)
    while (new := np.where(hit, label[None, :], label.max()).min(axis=1)).tolist() != label.tolist():
        label = new
    return Counter((int(i), int(n) - 1, int(c), bool(i == c)) for i, n, c in zip(ids, hit.sum(axis=1), label, strict=True))


def rows(ids, x):
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]


@pytest.fixture
def no_large_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    yield
    spark.conf.set(name, before)


def test_moves_vectors_a_few_times_however_many_tiles(spark, no_large_broadcasts):
    """Whole vectors once moved for every pair of tiles: here 67 MB, of 1.5 MB."""
    x = np.random.default_rng(3).standard_normal((6000, 64)).astype(np.float32)
    x[5000:5400] = x[:400] + 0.02 * np.random.default_rng(4).standard_normal((400, 64))
    df = spark.createDataFrame(rows(range(6000), x), "vec_id long, embedding array<float>").cache()
    df.count()
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = moved()
    got = link_vectors(df, tile=256).collect()
    assert moved() - before < 8 * x.nbytes
    assert Counter(map(tuple, got)) == answer(range(6000), x.astype(np.float64))
    df.unpersist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_sets_larger_than_a_task(spark, kind):
    rng = np.random.default_rng(11)
    crowd = rng.standard_normal(80) + 0.16 * rng.standard_normal((700, 80))  # links within, though not all
    chain = np.cumsum(0.24 * rng.standard_normal((300, 80)), axis=0) + rng.standard_normal(80)
    x = np.concatenate([crowd, chain, rng.standard_normal((200, 80))]).astype(np.float32 if kind == "float" else np.float64)
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame(rows(ids, x), f"vec_id long, embedding array<{kind}>")
    want = answer(ids, x.astype(np.float64))
    assert max(Counter(c for _, _, c, _ in want.elements()).values()) > 128
    assert Counter(map(tuple, link_vectors(df, tile=16).collect())) == want


@pytest.mark.parametrize("d", [3, 40, 100])
def test_sketches_lose_no_link(d, monkeypatch):
    monkeypatch.setattr(embdedup, "LEAF", 16)
    monkeypatch.setattr(embdedup, "ROWS", 8)
    monkeypatch.setattr(embdedup, "PRODUCTS", 64)
    rng = np.random.default_rng(d)
    base = rng.standard_normal((250, d)) * np.linspace(3, 0.3, d)
    angle = rng.uniform(0, 0.5, 250)[:, None]  # around arccos 0.95 = 0.318
    away = rng.standard_normal((250, d))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    away -= (away * unit).sum(axis=1)[:, None] * unit
    x = np.concatenate([unit, unit * np.cos(angle) + away / np.linalg.norm(away, axis=1)[:, None] * np.sin(angle), np.eye(d)[:3]])
    x = x[rng.permutation(len(x))]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    code, off = sketch(x, axes)
    u, off = units(code), np.arcsin(off)
    for cut in (0, 200):
        a, b = (u, None) if not cut else (u[:cut], u[cut:])
        root = may_link(a, b, off[: len(a)], off[cut:], float(np.arccos(0.95)))
        i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        if cut:
            i, j = i[(i < cut) & (j >= cut)], j[(i < cut) & (j >= cut)]
        assert len(i) and (root[i] == root[j]).all()
        if d > 3:  # and hardly more than the links
            loose = (x @ x.T >= 0.9) & np.triu(np.ones((len(x), len(x)), bool), 1)
            assert len(np.unique(root)) >= len(x) - loose.sum()
