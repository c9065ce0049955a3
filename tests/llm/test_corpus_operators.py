"""Near-duplicates, substrings, mixing and vectors against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm.ann import search
from driftloom.llm.embdedup import link_vectors
from driftloom.llm.graph import components
from driftloom.llm.minhash import near_duplicates, registers, similarity_estimate
from driftloom.llm.mixing import mix
from driftloom.llm.substring import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)]
    df = spark.createDataFrame(links + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == reach(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).count() == 0


# --- Near-duplicates ---------------------------------------------------------------------------


def shingles(text, size):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_table():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (7, "İstanbul one"), (8, "one two three four five")]
    n = 10
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n"]).join(copy)))
            n += 1
    text = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(150):  # one large group of near copies
        copy = list(text)
        copy[rng.randrange(200)] = "x"
        copy[rng.randrange(200)] = f"y{i}"
        rows.append((n + i, " ".join(copy)))
    return rows + [(6, "one two"), (n + 500, "the of " * 3000)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = near_table()
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = reach(ids, links)
    df = spark.createDataFrame(rows + [(None, "one two")], "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = Counter(tuple(r) for r in near_duplicates(df, size=size).collect())
    want = Counter((i, len(sets[i]), root[i], root[i] == i) for i, _ in rows)
    want[(None, len(shingles("one two", size)), None, False)] += 1
    missing = Counter({k: v for k, v in got.items() if k[0] is None})
    assert got - missing == Counter({k: v for k, v in want.items() if k[0] is not None})
    assert sum(missing.values()) == 1
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_in_tiles(spark, monkeypatch):
    """Links found in tiles join what all similar pairs of a bucket would, if nothing in it is linked yet."""
    from driftloom.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 7)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    other = np.concatenate([base[:240], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])
    rows, sets = [], {}
    for i in range(60):
        own = (base if i % 2 else other).copy()
        own[: rng.integers(0, 90)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        own[150 : 150 + rng.integers(0, 60)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets[i] = np.unique(own)
        rows.append((i, len(sets[i]), i, bytearray(registers(sets[i]).tobytes()), bytearray(sets[i].tobytes())))
    df = spark.createDataFrame(rows, "node long, n long, component long, registers binary, shingles binary")
    apart = df.select("node", "n", "component", F.explode(minhash.band_keys(F.col("registers"))).alias("key"))
    once = minhash.grouped(apart)
    assert once.count() == 60 and once.select("key").distinct().count() < 60  # however many bands they share
    got = {tuple(r) for r in minhash.across(once.join(df.select("node", "registers", "shingles"), "node"), 80).collect()}
    all_links = {(a, b) for a in sets for b in sets if a < b and minhash.similar(sets[a], sets[b], 80)}
    assert got <= all_links and reach(sets, got) == reach(sets, all_links)
    assert 1 < len(set(reach(sets, all_links).values())) < 60 and len(got) < len(all_links)


def test_tiles_look_as_far_down_as_small_buckets(spark):
    """A similar pair of large buckets is verified from 5 errors below the threshold on, like any other."""
    from driftloom.llm import minhash

    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])  # 800 of 1,000
    own = registers(np.unique(a))
    other = own.copy()
    # Registers as unlucky as can be: 0.70 of them equal, the first band among them.
    far = rng.permutation(np.arange(minhash.ROWS, minhash.REGISTERS))[: round(0.30 * minhash.REGISTERS)]
    other[far[::2]] += 1
    other[far[1::2]] -= 1
    estimate = similarity_estimate(own[None], other[None], np.array([900.0]), np.array([900.0]))[0]
    assert minhash.least_estimate(80) <= estimate < 0.71 and (own == other).mean() < 0.71
    rows = [(i, 900, i, bytearray(r.tobytes()), bytearray(np.unique(x).tobytes())) for i, r, x in ((1, own, a), (2, other, b))]
    df = spark.createDataFrame(rows, "node long, n long, component long, registers binary, shingles binary")
    assert {tuple(r) for r in minhash.across(df.withColumn("key", F.lit(0).cast("bigint")), 80).collect()} == {(1, 2)}


def test_tiles_of_one_component_do_not_meet(spark, monkeypatch):
    """Members of different components meet exactly once; a large component with few others costs few rows."""
    from driftloom.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 7)
    component = [0] * 600 + [600, 600, 602, 603, 604]
    rows = [(1, i, c) for i, c in enumerate(component)]
    rows += [(2, i, c) for i, c in enumerate([5] * 30 + [9] * 20 + [11] * 7)] + [(3, i, i) for i in range(40)] + [(4, i, 8) for i in range(30)]
    left, right = (x.collect() for x in minhash.in_tiles(spark.createDataFrame(rows, "key long, node long, component long")))
    assert len([r for r in left + right if r["key"] == 1]) < 3 * 605  # every two tiles: 605 x 87 and more
    groups = {}
    for side, rs in enumerate((left, right)):
        for r in rs:
            groups.setdefault((r["key"], r["tile"], r["other"]), ([], []))[side].append(r)
    met = Counter()
    for (key, tile, other), (xs, ys) in groups.items():
        assert tile <= other
        for a in xs:
            for b in ys:
                if a["component"] != b["component"] and (tile != other or a["node"] < b["node"]):
                    met[key, min(a["node"], b["node"]), max(a["node"], b["node"])] += 1
    want = Counter((k, a, b) for k, a, x in rows for l, b, y in rows if k == l and a < b and x != y)
    assert met == want


def test_bands_miss_few_pairs(spark):
    """Of the band keys that Spark makes and those that tiles see, the same are shared; few pairs share none."""
    from driftloom.llm import minhash

    rng = np.random.default_rng(8)
    own = rng.integers(100, 120, (40, minhash.REGISTERS)).astype(np.uint8)
    equal = rng.random((40, minhash.REGISTERS)) < np.linspace(0.5, 0.95, 40)[:, None]
    rows = [(i, bytearray(a.tobytes()), bytearray(np.where(e, a, a + 1).astype(np.uint8).tobytes())) for i, (a, e) in enumerate(zip(own, equal, strict=True))]
    keys = spark.createDataFrame(rows, "i long, a binary, b binary").select("i", *[minhash.band_keys(F.col(c)).alias(c) for c in "ab"])
    any_ = minhash.share_a_band(equal)
    for r in keys.collect():
        shared = [k for k, (x, y) in enumerate(zip(r["a"], r["b"], strict=True)) if x == y]
        assert len(set(r["a"])) == len(r["a"]) and any_[r["i"]] == bool(shared)
    # 0.808 of the registers of a pair at 0.8 are equal.
    missed = sum(int((~minhash.share_a_band(rng.random((50_000, minhash.REGISTERS)) < 0.808)).sum()) for _ in range(8))
    assert missed <= 20  # 5e-5; the 60 bands before missed about 110


def test_register_estimates():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        n = 600
        both = int(round(2 * n * share / (1 + share)))
        est = []
        for _ in range(20):
            items = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = registers(items[:n]), registers(items[n - both :])
            est.append(similarity_estimate(a[None], b[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(est) - share) < 0.03


# --- Substrings --------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [10_000, 3])
def test_substrings(spark, bucket_rows):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passage, other = make(70), make(50)
    rows = [(0, None), (1, ""), (2, " ".join(make(49)))]
    rows += [(i, " ".join(make(30) + passage + make(rng.choice([0, 5, 60])))) for i in range(10, 40)]
    rows += [(i, "\n".join(other)) for i in range(50, 55)] + [(60, " ".join(other[:49])), (61, " ".join(passage + other + passage))]
    rows += [(70, "a b " * 100), (71, "b a " * 100), (72, " ".join(make(400)))]
    rows += [(73, rows[-1][1]), (73, rows[-1][1]), (73, " ".join(make(60)))]
    first = defaultdict(lambda: 10**9)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first[tuple(w[k : k + 50])], i)
    want = Counter()
    for i, w in split:
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    nobody = " ".join(passage)
    want[(None, 70, 0, hashlib.sha256(nobody.encode()).hexdigest())] += 1
    df = spark.createDataFrame(rows + [(None, nobody)], "doc_id long, text string").withColumn("print", F.lit(0))
    got = Counter(tuple(r) for r in dedup_substrings(df, bucket_rows=bucket_rows).collect())
    assert got == want
    assert dedup_substrings(df.limit(0)).count() == 0


# --- Mixing ------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(600)]
    rows += [(700, "w " * 50, "tiny"), (701, None, "zero"), (5, rows[5][1], rows[5][2]), (None, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1))
    quality = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 3)] + [(3, None), (3, 0)], "doc_id long, quality int")
    out = mix(df, quality, parts=8).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(size.values())
    while True:
        level = left / (sum(weight[s] for s in open_) or 1)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, out)) == sorted(map(str, mix(df, quality, parts=512).collect()))
    assert mix(df.limit(0), quality).count() == 0


# --- Vectors -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    near = base[:60] + 0.08 * rng.standard_normal((60, 16))
    crowd = base[5] + 0.02 * rng.standard_normal((400, 16))
    data = np.concatenate([base, near, crowd, np.repeat(base[9:10], 40, axis=0), 3 * base[:5]]).astype(np.float32)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16), (9006, [1.0] * 3), (None, [1.0] * 16), (0, rows[0][1])]
    return rows, odd


@pytest.mark.parametrize("tile", [64, 4096])
def test_vector_links(spark, vector_rows, tile):
    rows, odd = vector_rows
    good = rows + [(0, rows[0][1])]
    x = np.array([v for _, v in good], dtype=np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    root = reach([i for i, _ in good], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(hit), strict=True) if a < b])
    want = Counter((i, int(hit[k].sum()) - 1, root[i], root[i] == i) for k, (i, _) in enumerate(good))
    want.update((i, 0, i, i is not None) for i, _ in odd[:-1])
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1))
    assert Counter(tuple(r) for r in link_vectors(df, tile=tile).collect()) == want
    assert link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, chunk", [(8192, 1024), (50, 7)])
def test_nearest(spark, vector_rows, block, chunk):
    rows, odd = vector_rows
    good = rows + [(0, rows[0][1])]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=np.float32).astype(np.float64)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in search(df, F.col("id") % 20 == 0, 20, block=block, chunk=chunk).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in {i for i in ids.tolist() if i % 20 == 0 and i}:  # 0 is there twice
        own = np.flatnonzero(ids == q)[0]
        score = x @ x[own]
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - float(x[own] @ x[np.flatnonzero(ids == m[1])[0]])) < 1e-9 for m in mine)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] <= b[1] for a, b in zip(mine, mine[1:], strict=False))
        total += 20
        hits += sum(m[2] >= -want[-1][0] - 1e-9 for m in mine)
    assert hits / total >= 0.99
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert search(few, F.col("id") % 20 == 0).count() == 4
    assert search(few.limit(0), F.col("id") % 20 == 0).count() == 0
