"""A whole run on a hand-made week."""

from pyspark.sql import functions as F

from driftloom import schemas
from driftloom.operators import digest as D
from driftloom.operators import reports as R
from driftloom.operators import state as S
from driftloom.plans.weekly import weekly_run

ITEM = (
    "run_id long, entity_id string, platform string, item_id string, item_text string, title string, text string, url string, "
    "date string, author string, channel string, comments array<string>, seq long"
)


def week(spark, summary_only, summarize=None):
    entities = spark.createDataFrame(
        [(1, "acme", 0, "Acme", "https://acme.example"), (1, "bee", 1, "Bee", "https://bee.example")],
        "run_id long, entity_id string, position long, name string, website_url string",
    )
    captures = spark.createDataFrame(
        [(1, "acme", "homepage", "Acme  homepage", None, [], 1), (1, "acme", "pricing", "", "timeout", [], 2),
         (1, "bee", "homepage", "new text", None, [], 3), (1, "bee", "blog", "Post", None, ["Post | /p"], 4)],
        "run_id long, entity_id string, page_type string, content_text string, error string, items array<string>, seq long",
    ).withColumn("checked_at", F.lit("2026-03-01").cast("timestamp_ntz"))
    known = spark.createDataFrame(
        [("acme", "homepage", "Acme homepage"), ("bee", "homepage", "old text")], "entity_id string, page_type string, t string"
    ).select("entity_id", "page_type", F.sha2("t", 256).alias("content_hash"))
    rows = [
        (1, "acme", "reddit", "rp1", "t", "Acme costs $199 per month", "We were quoted $199 per month.", "https://r.example/rp1",
         "2026-03-01", "x", "smallbusiness", ["c1"], 10),
        (1, "acme", "linkedin", "ad0", "t", "", "old ad", "", "2026-03-01", "", "", [], 11),
        (1, "acme", "linkedin", "ad1", "t", "", "fresh ad", "", "2026-03-01", "", "", [], 12),
        (1, "bee", "apidirect_linkedin", "q", "t", "", "bee post", "", "2026-03-01", "", "", [], 13),
    ]
    observed = spark.createDataFrame(rows, ITEM).withColumn("seen_at", F.lit("2026-03-01").cast("timestamp_ntz"))
    state = spark.createDataFrame([("acme", "linkedin", "ad0", "old ad", None, None, None)], schemas.ITEM_STATE)
    events = spark.createDataFrame(
        [(1, "acme", "website:homepage", "ok", None, 1), (1, "acme", "website:pricing", "failed", "timeout", 2),
         (1, "acme", "reddit:pricing", "ok", None, 3), (1, "acme", "linkedin:ads", "ok", None, 4)],
        "run_id long, entity_id string, source string, status string, note string, seq long",
    )
    kinds = {"reddit": "pricing_research", "linkedin": "linkedin_ads", "linkedin_organic": "linkedin_organic", "apidirect_linkedin": "linkedin_organic"}
    return weekly_run(entities, captures, known, observed, state, events, kinds, "2026-03-02", summary_only, summarize)


def test_week(spark):
    done = week(spark, summary_only=False)
    reports = {r.entity_id: r for r in done.reports.collect()}
    acme, bee = reports["acme"], reports["bee"]
    assert acme.homepage_change is None and bee.homepage_change == "• Content changed (summary unavailable)"
    assert bee.blog_change == "First scan — 1 post(s) indexed"
    assert acme.pricing_research_summary == "• Acme costs $199 per month (https://r.example/rp1)"
    assert acme.linkedin_ads_summary == "*1 new ad(s) detected*\n• fresh ad"
    assert bee.linkedin_organic_summary == "*LinkedIn (via API Direct)*\n• bee post"
    assert acme.coverage_summary == "Pricing page failed: timeout" and bee.coverage_summary is None
    saved = {(r.entity_id, r.summary_type) for r in done.summaries.collect()}
    assert ("bee", "blog_change") not in saved and ("bee", "homepage_change") in saved
    executive = done.executive.first().executive.splitlines()
    assert "• *Execution risk:* Acme: Pricing page failed: timeout" in executive
    assert executive[0].startswith("• Acme pricing update: Acme costs $199 per month") or executive[0].startswith("• *Messaging shift:*")
    assert executive[-1].startswith("• Coverage note:") and "1 competitor(s) (website 1)" in executive[-1]
    sent = D.digest_messages(D.pack_blocks(done.blocks)).collect()
    assert len(sent) == 1 and "Website Coverage" in sent[0].payload and sent[0].block_count <= 50
    items = {r.item_id: r for r in done.item_state.collect()}
    assert len(items) == 4 and items["ad0"].first_seen_at is None and items["ad0"].last_seen_at is not None
    assert {r.verdict for r in done.changes.filter("entity_id = 'acme'").collect()} == {"unchanged"}
    assert S.new_items(done.fresh_items, done.item_state).count() == 0


def test_summary_only_week(spark):
    blocks = week(spark, summary_only=True).blocks.collect()
    assert [b.kind for b in sorted(blocks, key=lambda b: b.block_no)] == ["header", "divider", "section", "divider", "context"]


def test_told_by_a_caller(spark):
    def tell(key, batches):
        titles = [t for batch in batches for t in batch.column("title").to_pylist()]
        return f"• {key['platform']}: {titles}" if key["kind"] != "linkedin_organic" else None

    reports = {r.entity_id: r for r in week(spark, False, tell).reports.collect()}
    assert reports["acme"].pricing_research_summary == "• reddit: ['Acme costs $199 per month']"
    assert reports["acme"].linkedin_ads_summary == "*1 new ad(s) detected*\n• linkedin: ['']"
    assert reports["bee"].linkedin_organic_summary == "*LinkedIn (via API Direct)*\n• bee post"


def test_a_hot_group_is_fed_in_batches(spark):
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")

    def tell(key, batches):
        n = most = 0
        last, ordered = -1, True
        for batch in batches:
            rows = batch.column("seq").to_pylist()
            ordered = ordered and rows == sorted(rows) and rows[0] > last
            last, n, most = rows[-1], n + 1, max(most, len(rows))
            if key["k"] == "left early":
                return f"{n}"
        return f"{n >= 50} {most <= 100} {ordered} {last}"

    try:
        names = F.when(F.col("id") < 5000, F.lit("hot")).when(F.col("id") < 5900, F.lit("left early"))
        rows = spark.range(6000).select(names.alias("k"), F.col("id").alias("seq")).repartition(7)
        out = {r.k: (r.item_count, r.summary_text) for r in R.summarize_groups(rows, ["k"], ["seq"], tell).collect()}
    finally:
        spark.conf.set(limit, before)
    assert out == {"hot": (5000, "True True True 4999"), "left early": (900, "1"), None: (100, "False True True 5999")}
    assert R.summarize_groups(rows.filter("seq < 0"), ["k"], ["seq"], tell).count() == 0
