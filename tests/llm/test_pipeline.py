"""The pipeline's stages, each against what its rule says of its own input."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from driftloom.llm.bpe import load_ranks
from driftloom.llm.common import written
from tests.llm.test_corpus_operators import reach, shingles
from tests.llm.test_text_operators import plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "score")
    extra = spark.createDataFrame(
        [(-1, None, "en", "src0", 1), (-2, "", None, None, 0), (-3, "123", "en", "s", 3), (None, "the thing and the other of it", "en", "src0", 4)], docs.schema
    )
    docs = written(docs.unionByName(extra).unionByName(docs.limit(1)), "pipeline-test")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), name))
        assert steps[-1].columns == columns or name == "bpe_tokens"
    start, told, apart, clean, mixed, tokens = [[r.asDict() for r in s.collect()] for s in steps]

    kept = {r["doc_id"] for r in told}
    assert not kept & {-1, -2, -3} and len(told) > 0.97 * (len(start) - 3)
    assert not Counter(map(str, told)) - Counter(map(str, start))

    sets = {r["doc_id"]: shingles(r["text"], 5) for r in told if r["doc_id"] is not None}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = reach(ids, links)
    assert sorted((r["doc_id"] for r in apart if r["doc_id"] is not None)) == [i for i in ids if root[i] == i]
    assert sum(r["doc_id"] is None for r in apart) == sum(r["doc_id"] is None for r in told)

    after = {r["doc_id"]: r for r in clean}
    assert len(clean) == len(apart)
    for r in apart:
        want, at = "", 0
        for a, _, b, _ in plain_spans(r["text"]):
            if a > at or not want:
                want += r["text"][at:a] + "[SECRET]"
            at = max(at, b)
        assert after[r["doc_id"]]["text"] == want + r["text"][at:]

    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= set(after) and max(times.values()) <= 2
    assert all(r == after[r["doc_id"]] for r in mixed)
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(size(mixed) / size(clean) - 1.5) < 0.1

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in tokens) == want


def test_near_dedup_keeps_the_text_that_was_kept(spark):
    """Of an id with a copy of another document and a text of its own, that text stays."""
    copy = "a text of more than five words that others copy"
    own = {i: " ".join(f"own{i}x{k}" for k in range(9)) for i in range(5, 25)}
    docs = spark.createDataFrame([(1, copy)] + [(i, t) for i in own for t in (copy, own[i])], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect())
    assert got == Counter([(1, copy), *own.items()])


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
