"""Change detection and keyed state: snapshots, items, runs, usage and retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.text import content_hash
from driftloom.functions.weeks import month_label
from driftloom.operators.fetch import fetch, latest_ids, parted
from driftloom.operators.segments import SEGMENT_ROWS, lag_over, running_sum
from driftloom.sources.inputs import has_error
from driftloom.sources.tables import written

PAGE_KEYS = ["entity_id", "page_type"]
ITEM_KEYS = ["entity_id", "platform", "item_id"]


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row per key. Ties in the leading order column go to the later ones, which are unique within a key.

    Only keys and order columns are aggregated; the rows are fetched afterwards.
    """
    return fetch(df, latest_ids(df, keys, *order), [*keys, *order]).select(*df.columns)


def usable_captures(captures: DataFrame) -> DataFrame:
    """Captures that hold text; failed and empty ones never reach change detection."""
    ok = F.col("content_text") != ""
    if "error" in captures.columns:
        ok = ok & ~has_error(F.col("error"))
    return captures.filter(ok)


def detect_changes(
    captures: DataFrame, state: DataFrame | None = None, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Label each capture ``first``, ``changed`` or ``unchanged`` against the one before it.

    ``state`` holds the last known ``content_hash`` per page; it precedes every capture here. Texts
    are hashed once, into a narrow table in the shared folder; they take no part in the window and
    are not in the result (see :func:`snapshots_to_append`).
    """
    hashed = usable_captures(captures).withColumn("content_hash", content_hash(F.col("content_text")))
    narrow = written(hashed.drop("content_text"), "hashes")
    rows = lag_over(narrow, PAGE_KEYS, "seq", "content_hash", "prev_hash", width, state)
    verdict = (
        F.when(F.col("prev_hash").isNull(), F.lit("first"))
        .when(F.col("prev_hash") != F.col("content_hash"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return rows.withColumn("verdict", verdict)


def changed_only(changes: DataFrame) -> DataFrame:
    """First and changed captures: the ones that are stored."""
    return changes.filter(F.col("verdict") != "unchanged")


def snapshots_to_append(changes: DataFrame, captures: DataFrame) -> DataFrame:
    """Stored rows of the first and changed captures; their texts are fetched by the unique ``seq``, no others move."""
    kept = changed_only(changes).select("seq", *PAGE_KEYS, "content_hash", "checked_at")
    return fetch(captures.select("seq", "content_text"), kept, ["seq"]).select(
        "seq", *PAGE_KEYS, "content_hash", "content_text", "checked_at"
    )


def changed_texts(
    changes: DataFrame, captures: DataFrame, snapshots: DataFrame | None = None, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Each changed capture's own text beside the stored one that it replaces: seq, page keys, old_seq, old_text, new_text.

    That is the text of the page's last first or changed capture before it; if none is here, of its newest row in
    ``snapshots``, whose seq are none of the captures'. Both are null if a page's state has no snapshot. Windows hold
    numbers only; texts are fetched by seq, so those of unchanged captures do not move.
    """
    kept = changed_only(changes).select("seq", *PAGE_KEYS, "verdict", F.col("seq").alias("_seq"))
    stored = captures.select("seq", "content_text")
    last = None
    if snapshots is not None:
        last = latest_ids(snapshots, PAGE_KEYS, "seq").withColumnRenamed("seq", "_seq")
        stored = stored.unionByName(snapshots.select("seq", "content_text"))
    pairs = lag_over(kept, PAGE_KEYS, "seq", "_seq", "old_seq", width, last).filter(F.col("verdict") == "changed")
    pairs = written(pairs.select("seq", *PAGE_KEYS, "old_seq"), "changed-pairs")
    own = captures.select("seq", F.col("content_text").alias("new_text"))
    before = stored.select(F.col("seq").alias("old_seq"), F.col("content_text").alias("old_text"))
    old = fetch(before, pairs.select("old_seq").filter(F.col("old_seq").isNotNull()), ["old_seq"])
    return fetch(own, pairs, ["seq"]).join(old, "old_seq", "left").select("seq", *PAGE_KEYS, "old_seq", "old_text", "new_text")


def page_state_of(snapshots: DataFrame) -> DataFrame:
    """Last stored hash per page."""
    return latest_by(snapshots.select(*PAGE_KEYS, "seq", "content_hash"), PAGE_KEYS, "seq")


def first_scan_note(changes: DataFrame) -> DataFrame:
    """Report-only note for the first scan of a list page that has items."""
    n = F.size("items")
    noun = F.when(F.col("page_type") == "blog", F.lit("post(s)")).otherwise(F.lit("job(s)"))
    eligible = (
        (F.col("verdict") == "first") & F.col("page_type").isin("blog", "careers") & (n > 0)
    )
    return changes.withColumn(
        "note", F.when(eligible, F.format_string("First scan — %d %s indexed", n, noun))
    )


def new_items(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Observed rows whose (entity, platform, item) is not in the known state.

    ``known`` has one row per key, so a hot observed key only makes the streamed side skewed, which
    adaptive execution splits.
    """
    return observed.join(known.select(*ITEM_KEYS), ITEM_KEYS, "left_anti")


def new_item_counts(observed: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """New rows and distinct new items; observations collapse to one row per key before the join."""
    per_item = observed.groupBy(*ITEM_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    fresh = per_item.join(known.select(*ITEM_KEYS), ITEM_KEYS, "left_anti")
    return fresh.groupBy(*by).agg(
        F.sum("_n").alias("new_rows"), F.count(F.lit(1)).alias("new_distinct")
    )


def observations_as_items(observed: DataFrame) -> DataFrame:
    """Observed rows in the shape of item state."""
    ref = F.col("item_ref") if "item_ref" in observed.columns else F.lit(None).cast("string")
    return observed.select(
        *ITEM_KEYS, "item_text", ref.alias("item_ref"),
        F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), "seq",
    )


def upsert_items(state: DataFrame | None, observed: DataFrame) -> DataFrame:
    """Insert unseen items; for known ones only the last-seen time moves.

    Sightings are aggregated as numbers, so those of a hot item meet before the shuffle; the text of a new item is
    fetched by the ``seq`` of its first sighting. Known items that were not seen again are passed on where they are.
    """
    fresh = observations_as_items(observed)
    seen = fresh.groupBy(*ITEM_KEYS).agg(F.min("seq").alias("seq"), F.max_by("last_seen_at", "seq").alias("_seen"))
    seen = written(seen, "sightings")
    columns = [*ITEM_KEYS, "item_text", "item_ref", "first_seen_at"]
    if state is None:
        return fetch(fresh.select("seq", *columns), seen, [*ITEM_KEYS, "seq"]).select(*columns, F.col("_seen").alias("last_seen_at"))
    again, rest = parted(state, seen, ITEM_KEYS)
    hit = seen.select(*ITEM_KEYS, "_seen", F.lit(True).alias("_hit"))
    known = again.join(hit, ITEM_KEYS, "left").select(*columns, F.when(F.col("_hit"), F.col("_seen")).otherwise(F.col("last_seen_at")).alias("last_seen_at"))
    if rest is not None:
        known = known.unionByName(rest.select(*columns, "last_seen_at"))
    unseen = seen.join(state.select(*ITEM_KEYS), ITEM_KEYS, "left_anti")
    new = fetch(fresh.select("seq", *columns), unseen, [*ITEM_KEYS, "seq"]).select(*columns, F.col("_seen").alias("last_seen_at"))
    return known.unionByName(new)


def start_run(runs: DataFrame) -> DataFrame:
    """Opening events: one ``running`` row per run."""
    return runs.select(
        "run_id", F.lit(0).alias("phase"), F.col("at"), F.lit("running").alias("status"),
        F.col("entity_count").cast("bigint").alias("entity_count"),
        F.lit(None).cast("string").alias("executive_summary"),
        F.lit(None).cast("double").alias("duration_seconds"),
    )


def finish_run(results: DataFrame) -> DataFrame:
    """Closing events: status, summary and duration."""
    return results.select(
        "run_id", F.lit(1).alias("phase"), F.col("at"), "status",
        F.lit(None).cast("bigint").alias("entity_count"),
        "executive_summary", F.col("duration_seconds").cast("double").alias("duration_seconds"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run from its opening and closing events."""
    closed = F.when(F.col("phase") == 1, F.col("at"))
    order = F.struct("phase", "at")
    last = F.max_by(F.struct("status", "executive_summary", "duration_seconds"), order)
    folded = events.groupBy("run_id").agg(
        F.min(F.when(F.col("phase") == 0, F.col("at"))).alias("started_at"),
        F.max(closed).alias("finished_at"),
        F.max("entity_count").alias("entity_count"),
        last.alias("_last"),
    )
    return folded.select("run_id", "started_at", "finished_at", "entity_count", "_last.*")


def run_metrics(fresh_items: DataFrame, changes: DataFrame, ad_platforms: list[str]) -> DataFrame:
    """New ads, new posts and changed pages per entity."""
    is_ad = F.col("platform").isin(*ad_platforms)
    items = fresh_items.groupBy("entity_id").agg(
        F.count_if(is_ad).alias("new_ads_count"), F.count_if(~is_ad).alias("new_posts_count")
    )
    pages = changes.groupBy("entity_id").agg(
        F.count_if(F.col("verdict") == "changed").alias("pages_changed_count")
    )
    merged = items.join(pages, "entity_id", "full")
    counts = ["new_ads_count", "new_posts_count", "pages_changed_count"]
    return merged.select("entity_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def usage_monthly(log: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Successful requests per endpoint and month, added to earlier counts."""
    fresh = log.filter("success").select(
        "endpoint", month_label(F.col("ts")).alias("month"), F.lit(1).cast("bigint").alias("n")
    )
    if prior is not None:
        fresh = fresh.unionByName(prior.select("endpoint", "month", F.col("request_count").alias("n")))
    return fresh.groupBy("endpoint", "month").agg(F.sum("n").alias("request_count"))


def admit(log: DataFrame, limit: int = V.MONTHLY_LIMIT, width: int = SEGMENT_ROWS) -> DataFrame:
    """Requests in log order, admitted while earlier successes of the month are below ``limit``."""
    monthly = log.withColumn("month", month_label(F.col("ts")))
    spent = running_sum(
        monthly, ["endpoint", "month"], "seq", F.col("success").cast("int"), "used", True, width
    )
    return spent.withColumn("admitted", F.col("used") < limit)


def cutoff(as_of: datetime, **age: int) -> Column:
    """``as_of`` minus an age, as a literal that can be pushed down to the scan."""
    return F.lit((as_of - timedelta(**age)).isoformat(sep=" ")).cast("timestamp_ntz")


def _old_latest(snapshots: DataFrame, cut: Column) -> DataFrame:
    newest = snapshots.groupBy(*PAGE_KEYS).agg(
        F.max_by("checked_at", "seq").alias("_at"), F.max("seq").alias("seq")
    )
    return newest.filter(F.col("_at") < cut).select("seq")


def prune_snapshots(snapshots: DataFrame, as_of: datetime, days: int = V.SNAPSHOT_DAYS) -> DataFrame:
    """Snapshots that survive retention: recent ones, and each page's latest however old.

    Recent rows come straight from the filtered scan; only the sequence numbers of old latest rows
    are aggregated, then semi-joined, so no text is shuffled for the recent part.
    """
    cut = cutoff(as_of, days=days)
    recent = snapshots.filter(F.col("checked_at") >= cut)
    old = snapshots.filter(F.col("checked_at") < cut)
    return recent.unionByName(old.join(_old_latest(snapshots, cut), "seq", "left_semi").select(*recent.columns))


def prune_items(items: DataFrame, as_of: datetime, days: int = V.ITEM_DAYS) -> DataFrame:
    """Items seen within the retention time."""
    return items.filter(F.col("last_seen_at") >= cutoff(as_of, days=days))


def prune_report(snapshots: DataFrame, items: DataFrame, as_of: datetime,
                 snapshot_days: int = V.SNAPSHOT_DAYS, item_days: int = V.ITEM_DAYS) -> DataFrame:
    """How many rows retention removes from each table."""
    cut = cutoff(as_of, days=snapshot_days)
    per_page = snapshots.groupBy(*PAGE_KEYS).agg(
        F.count_if(F.col("checked_at") < cut).alias("old"),
        (F.max_by("checked_at", "seq") < cut).cast("bigint").alias("kept_old"),
    )
    pages = per_page.agg(F.coalesce(F.sum(F.col("old") - F.col("kept_old")), F.lit(0)).alias("pruned"))
    stale = F.col("last_seen_at") < cutoff(as_of, days=item_days)
    gone = items.agg(F.count_if(stale).alias("pruned"))
    return pages.select(F.lit("snapshots").alias("table_name"), "pruned").unionByName(
        gone.select(F.lit("items").alias("table_name"), "pruned")
    )
