"""Owners of equal texts against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.llm.exactdup import Trie, exact_owners


def brute(rows, pick):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        owner = pick(known) if known else None
        out += [(i, owner, len(ids), i == owner, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def random_rows(seed, n=600):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "é", "日本", "x" * 400, "", " ", "\n"]
    rows = [(rng.randrange(10_000), "".join(rng.choice(words) for _ in range(rng.randrange(4)))) for _ in range(n)]
    rows += [(20_000 + i, "hot text") for i in range(n // 2)] + [(None, "no id"), (None, "no id"), (None, "hot text"), (5, None), (6, ""), (6, "")]
    rows += [(30_000, "y" * 300_000), (30_001, "y" * 300_000), (30_002, "y" * 299_999 + "z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("largest", "sizes"), [
    (True, {}),
    (False, {"block_bytes": 2000, "part_bytes": 200_000, "trie_bytes": 3000}),
    (True, {"block_bytes": 2000, "part_bytes": 1 << 30, "trie_bytes": 2000, "lane_blocks": 3}),
    (False, {"block_bytes": 3000, "part_bytes": 200_000, "trie_bytes": 1000, "lane_blocks": 2, "hashed": lambda text: 7}),
])
def test_owners(spark, largest, sizes):
    rows = random_rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_owners(df, largest=largest, **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, max if largest else min)


def test_other_columns_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "A", 5, "x"), (2, "a", 6, "y")], "key long, `the text` string, node long, hash string")
    got = exact_owners(df, "key", "the text", normal=F.lower).collect()
    assert sorted((r["key"], r["owner"], r["group_size"], r["kept"]) for r in got) == [(1, 1, 2, True), (2, 1, 2, False)]
    empty = exact_owners(df.limit(0), "key", "the text")
    assert empty.columns == ["key", "owner", "group_size", "kept", "digest"] and empty.count() == 0


def test_trie_splits_labels_and_sheds_whole_subtrees():
    rng = random.Random(1)
    texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(800)})
    trie, gone = Trie(), []
    for text in rng.sample(texts, len(texts)):
        node = trie.at(text)
        if node.stub is None:
            node.value = [text]
        else:
            gone.append(text)
        if trie.size > 20_000:
            gone += [t for t, _ in trie.shed(1)]
    left = [t for t, _ in trie.walk(trie.root)]
    assert gone and left and sorted(gone + left) == texts
    assert not {t[:1] for t in gone} & {t[:1] for t in left if t}
