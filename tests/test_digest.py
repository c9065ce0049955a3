"""Digest blocks and packing."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.operators import coverage as C
from driftloom.operators import digest as D
from driftloom.operators import reports as R


def pack(spark, dividers, n, size=50, width=100_000):
    rows = [("r", i, "divider" if i in dividers else "section", "t") for i in range(n)]
    df = spark.createDataFrame(rows, "run_id string, block_no long, kind string, text string")
    out = D.pack_blocks(df, size, width).orderBy("block_no").collect()
    assert [r.block_no for r in out] == list(range(n))
    numbers = [r.message_no for r in out]
    assert numbers == sorted(numbers) and numbers[0] == 0
    return [numbers.count(m) for m in range(numbers[-1] + 1)]


def greedy(dividers, n, size):
    sizes, start = [], 0
    while start < n:
        end = start + size
        stops = [d for d in dividers if start < d < end]
        after = n if end >= n else (max(stops) + 1 if stops else end)
        sizes.append(after - start)
        start = after
    return sizes


def test_divider_at_fifty_never_makes_51_blocks(spark):
    assert pack(spark, {1, 50, 80}, 120) == [2, 49, 30, 39]


def test_short_digest_is_one_message(spark):
    assert pack(spark, {1, 3}, 5) == [5]


@pytest.mark.parametrize("seed,width", [(1, 64), (2, 101), (3, 50), (4, 100_000), (5, 73)])
def test_packing_across_segments(spark, seed, width):
    rnd = random.Random(seed)
    n = rnd.randint(300, 700)
    dividers = {i for i in range(n) if rnd.random() < rnd.choice([0.01, 0.1, 0.3])}
    sizes = pack(spark, dividers, n, 50, width)
    assert sizes == greedy(dividers, n, 50) and max(sizes) <= 50


@pytest.mark.parametrize("seed,width,batch", [(1, 64, 7), (2, 50, 64), (3, 100_000, 1000), (4, 101, 10_000)])
def test_many_digests_are_packed_together(spark, seed, width, batch):
    rnd = random.Random(seed)
    sizes = {f"r{i}": rnd.choice([1, 5, 49, 50, 51, rnd.randint(2, 300)]) for i in range(60)}
    dividers = {r: {i for i in range(n) if rnd.random() < rnd.choice([0, 0.01, 0.2])} for r, n in sizes.items()}
    rows = [(r, i, "divider" if i in dividers[r] else "section", "t") for r, n in sizes.items() for i in range(n)]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "run_id string, block_no long, kind string, text string")
        packed = D.pack_blocks(df, 50, width)
        assert "InPandas" not in packed._jdf.queryExecution().toString()
        got = {}
        for row in packed.orderBy("run_id", "block_no").collect():
            got.setdefault(row.run_id, []).append(row.message_no)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r: [m for m, k in enumerate(greedy(dividers[r], n, 50)) for _ in range(k)] for r, n in sizes.items()}


def test_short_segments_of_a_batch_come_at_once():
    columns = {"run_id": [i // 5 for i in range(5000)], "segment": [0] * 5000, "block_no": [i % 5 for i in range(5000)]}
    given = pa.table(columns).to_batches(max_chunksize=999)
    parts = list(D.whole_segments(iter(given)))
    assert len(parts) <= len(given) + 1 and pa.concat_tables(parts).to_pydict() == columns
    firsts, lasts = ([p["run_id"][i].as_py() for p in parts] for i in (0, -1))
    assert all(last < first for last, first in zip(lasts, firsts[1:]))


def entity(spark, sources=(), **fields):
    base = {"run_id": 1, "position": 0, "entity_id": "acme", "name": "Acme Corp", "website_url": "https://a.example", **fields}
    kinds = {"run_id": "long", "position": "long"}
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base))
    events = spark.createDataFrame([(1, "acme", s, st, n, i) for i, (s, st, n) in enumerate(sources)],
                                   "run_id long, entity_id string, source string, status string, note string, seq long")
    keys = ["run_id", "entity_id"]
    statuses = C.source_status(events, keys)
    return R.complete_report(df).join(C.source_lists(statuses, keys), keys, "left")


def texts(spark, report, executive="• Pricing shifted to usage credits.", summary_only=False):
    runs = spark.createDataFrame([(1, executive, "2026-03-02")], "run_id long, executive string, run_date string")
    out = D.digest_blocks(report, runs, "position", summary_only).orderBy("block_no").collect()
    assert [r.block_no for r in out] == list(range(len(out)))
    return [r.text for r in out if r.text]


def test_summary_only_has_no_entity(spark):
    out = "\n".join(texts(spark, entity(spark, linkedin_ads_summary="• test"), summary_only=True))
    assert "*Executive Summary:*" in out and "Acme Corp" not in out


def test_failures_replace_defaults(spark):
    report = entity(spark, [("linkedin:ads", "failed", "auth wall"), ("linkedin:organic", "failed", "checkpoint")])
    out = "\n".join(texts(spark, report))
    assert ":warning: *LinkedIn Ads:* failed (auth wall)" in out and "(checkpoint)" in out
    assert "No new ads" not in out and "No new posts" not in out and "*Website:* Not configured" in out


def test_unset_and_quiet_sources(spark):
    report = entity(spark, [("website:blog", "ok", None), ("linkedin:ads", "not_configured", None), ("reddit:pricing", "skipped", None)])
    out = texts(spark, report)
    assert ":white_check_mark: *Website:* No changes detected this week" in out
    assert "*LinkedIn Ads:* Not configured" in out and "*LinkedIn Organic:* No new posts in last 7 days" in out
    assert "*Pricing Intel (Reddit):*\n:information_source: *Pricing Intel (Reddit):* skipped" in out


def test_error_short_circuits(spark):
    out = texts(spark, entity(spark, error="boom", homepage_change="x"), executive=None)
    assert out[1:] == ["*Acme Corp*  |  <https://a.example|https://a.example>", ":warning: *Error:* boom", D.FOOTER]


def test_coverage_counts_open_sources_only(spark):
    rows = [(1, "a", "website:pricing", "failed", "timeout", 0), (1, "a", "reddit:pricing", "not_needed", "x", 1),
            (1, "a", "linkedin:ads", "skipped", "y", 2)]
    events = spark.createDataFrame(rows, "run_id long, entity_id string, source string, status string, note string, seq long")
    bullet = C.coverage_bullet(C.source_status(events, ["run_id", "entity_id"]), ["run_id"]).first().bullet
    assert "1 competitor(s) (website 1, LinkedIn 1)" in bullet and "Reddit" not in bullet


def reports(spark, *rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)],
                               "run_id long, position long, name string, pricing_research_summary string, linkedin_ads_summary string, error string")
    return R.complete_report(df)


def test_fallback_card(spark):
    df = reports(spark, ("Acme", "• Moved from per-seat pricing to usage credits for AI agents.", "• New campaigns target electricians.", None))
    out = df.select(R.fallback_card().alias("c")).first().c
    assert out.startswith("Competitor: Acme\nSignals:\n- Pricing/packaging: Moved") and "- Messaging/GTM: New campaigns" in out


def test_executive_prefers_pricing_and_isolates_risk(spark):
    df = reports(spark, ("A", "• $5 per seat plan", "• ads", "timeout"), ("B", "• No concrete customer pricing figures were found.", "• launch", None),
                 ("C", "• Moved to a credit plan.", None, None))
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    out = {r.run_id: r.executive for r in R.executive_summary(runs, df, ["run_id"], "position").collect()}
    assert out[2] == "• No competitors were processed in this run."
    assert "• *Pricing watch:* B: No concrete" in out[1] and "• *Execution risk:* A: timeout" in out[1]
    assert R.pricing_bullet(df, ["run_id"], "position").first().pricing_bullet == "• A pricing update: $5 per seat plan."


def test_executive_reads_reports_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    reports(spark, ("A", None, None, None), ("B", "• $5 per seat plan", None, "timeout"), ("C", "• $9 per seat plan", None, "x")).write.parquet(path)
    runs = spark.createDataFrame([(1,)], "run_id long")
    out = R.executive_summary(runs, spark.read.parquet(path), ["run_id"], "position")
    assert out.first().executive == "• B pricing update: $5 per seat plan.\n• *Execution risk:* B: timeout"
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().mkString(" ").count("parquet") == 1


def test_pricing_bullet_skips_non_material(spark):
    df = reports(spark, ("A", "• No concrete customer pricing figures were found.", None, None))
    assert R.pricing_bullet(df, ["run_id"], "position").count() == 0


def test_needs_pricing_research(spark):
    entities = spark.createDataFrame([(str(i), u) for i, u in enumerate(["u", "u", "u", None, "u"])], "entity_id string, pricing_url string")
    pages = spark.createDataFrame([("0", "from $99", None), ("1", "", "timeout"), ("2", "contact us", None)], "entity_id string, text string, error string")
    out = {r.entity_id: r.needed for r in C.needs_pricing_research(entities, pages).collect()}
    assert out == {"0": False, "1": True, "2": True, "3": True, "4": False}


def test_cascade(spark):
    rows = [(1, 0, "a", True, "ok", None), (1, 1, "b", False, "ok", None), (1, 2, "c", True, "expired", None), (1, 3, "d", True, "ok", None),
            (2, 0, "e", True, "partial", "ok"), (2, 1, "f", True, "partial", None)]
    df = spark.createDataFrame(rows, "run_id long, run_pos long, entity_id string, has_id boolean, outcome string, ads_status string")
    df = df.withColumns({"organic_status": F.lit(None).cast("string"), "note": F.lit("")})
    out = {r.entity_id: (r.ads, r.organic, first) for r in C.cascade_skips(df).collect() for first in [r.organic_note]}
    assert out["a"][:2] == ("ok", "ok") and out["b"][:2] == ("not_configured", "not_configured")
    assert out["c"][:2] == ("failed", "skipped") and out["d"] == ("skipped", "skipped", "session expired earlier in run")
    assert out["e"] == ("ok", "failed", "unknown scrape failure") and out["f"][:2] == ("failed", "failed")
