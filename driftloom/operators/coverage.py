"""Source statuses: folding, coverage lines, fallback routing and skip cascades."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.predicates import has_specific_price
from driftloom.functions.text import blank_to_null, strip
from driftloom.operators.fetch import fetch
from driftloom.operators.posts import top_n
from driftloom.sources.inputs import has_error


def source_label(source: Column, digest: bool = False) -> Column:
    """Display name of a source; unknown sources show their key."""
    pairs = [(F.lit(k), F.lit(v[int(digest)])) for k, v in V.SOURCE_LABELS.items()]
    names = F.create_map(*chain.from_iterable(pairs))
    return F.coalesce(F.try_element_at(names, source), source)


def source_status(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current status per source: the last write wins, its position is that of the first write."""
    note = F.when(F.col("note") != "", strip(F.col("note")))
    ends = events.groupBy(*keys, "source").agg(F.max("seq").alias("seq"), F.min("seq").alias("position"))
    return fetch(events.select(*keys, "source", "seq", "status", "note"), ends, [*keys, "source", "seq"]).select(
        *keys, "source", "status", note.alias("note"), "position"
    )


def source_lists(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """All sources of an entity as one ordered array; bounded by the source vocabulary."""
    entry = F.struct("position", "source", "status", "note")
    return statuses.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("sources"))


def is_open(status: Column) -> Column:
    return status.isin(*V.OPEN_STATUSES)


def needs_pricing_research(entities: DataFrame, pricing_captures: DataFrame) -> DataFrame:
    """Whether each entity's pricing must be looked up elsewhere.

    ``pricing_captures`` holds one pricing capture per entity: ``text`` and ``error``.
    """
    pages = pricing_captures.select("entity_id", "text", "error", F.lit(True).alias("_captured"))
    joined = entities.join(pages, "entity_id", "left")
    no_url = F.coalesce(F.col("pricing_url"), F.lit("")) == ""
    failed = F.col("_captured") & (
        F.coalesce(blank_to_null(F.col("error")).isNotNull(), F.lit(False))
        | (F.coalesce(F.col("text"), F.lit("")) == "")
    )
    vague = F.col("_captured") & ~has_specific_price(F.col("text"))
    needed = no_url | F.coalesce(failed, F.lit(False)) | F.coalesce(vague, F.lit(False))
    return joined.select(
        "entity_id",
        needed.alias("needed"),
        F.when(~needed, F.lit("not_needed")).alias("status"),
        F.when(~needed, F.lit(V.NOT_NEEDED_NOTE)).alias("note"),
    )


def route_fallbacks(statuses: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Which alternate feeds each entity needs.

    ``reports`` tells which summaries exist: linkedin_organic_summary, pricing_research_summary and
    reddit_discussion_summary.
    """

    def opened(source: str) -> Column:
        return F.bool_or((F.col("source") == source) & is_open(F.col("status")))

    def missing(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit("")) == ""

    flags = statuses.groupBy(*keys).agg(
        (opened("linkedin:ads") | opened("linkedin:organic")).alias("_network"),
        (opened("reddit:pricing") | opened("reddit:discussion")).alias("_forum"),
    )
    joined = flags.join(reports, keys, "left")
    nothing = missing("pricing_research_summary") & missing("reddit_discussion_summary")
    return joined.select(
        *keys,
        (F.col("_network") & missing("linkedin_organic_summary")).alias("network_fallback"),
        ((F.col("_forum") | nothing) & missing("reddit_discussion_summary")).alias("forum_fallback"),
    )


def cascade_skips(attempts: DataFrame) -> DataFrame:
    """Statuses of the two sign-in sources after failures spread through a run.

    ``attempts`` has run_id, run_pos, entity_id, has_id, outcome (``ok``, ``expired`` or
    ``partial``), ads_status, organic_status (set before a partial failure) and note. The first
    expired attempt per run is one aggregated row, so no run is windowed as a whole.
    """
    expired = F.col("has_id") & (F.col("outcome") == "expired")
    first = attempts.filter(expired).groupBy("run_id").agg(F.min("run_pos").alias("_expired_at"))
    joined = attempts.join(first, "run_id", "left")
    later = F.col("run_pos") > F.col("_expired_at")
    blame = F.coalesce(blank_to_null(F.col("note")), F.lit("unknown scrape failure"))

    def pick(idle: Column, skipped: Column, own: Column, kept: Column, failed: Column, fine: Column) -> Column:
        return (
            F.when(~F.col("has_id"), idle)
            .when(later, skipped)
            .when(F.col("outcome") == "expired", own)
            .when((F.col("outcome") == "partial") & kept.isNotNull(), kept)
            .when(F.col("outcome") == "partial", failed)
            .otherwise(fine)
        )

    none = F.lit(None).cast("string")

    def status(kept: str, own: str) -> Column:
        return pick(F.lit("not_configured"), F.lit("skipped"), F.lit(own), F.col(kept), F.lit("failed"), F.lit("ok"))

    def note(kept: str, own: str) -> Column:
        filled = F.when(F.col(kept).isNull(), blame)
        return (
            F.when(F.col("outcome") == "partial", pick(none, F.lit(V.EXPIRED_EARLIER), none, none, filled, none))
            .otherwise(pick(none, F.lit(V.EXPIRED_EARLIER), F.lit(own), none, none, none))
        )

    return joined.select(
        "run_id", "run_pos", "entity_id",
        status("ads_status", "failed").alias("ads"),
        note("ads_status", "session expired").alias("ads_note"),
        status("organic_status", "skipped").alias("organic"),
        note("organic_status", "session expired — organic post scan skipped").alias("organic_note"),
    )


def coverage_summary(statuses: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """One line per entity naming its first open sources; entities without any are absent."""
    note = blank_to_null(F.col("note"))
    text = F.concat(
        source_label(F.col("source")), F.lit(" "), F.col("status"),
        F.coalesce(F.concat(F.lit(": "), note), F.lit("")),
    )
    issues = statuses.filter(is_open(F.col("status"))).withColumn("_text", text)
    shown = top_n(issues, keys, ["position"], n)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "_text")))
    return shown.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda p: p["_text"]), "; ").alias("coverage_summary")
    )


def coverage_bullet(statuses: DataFrame, run_keys: list[str]) -> DataFrame:
    """One bullet per run: open sources by kind, and how many entities they touch."""
    issues = statuses.filter(is_open(F.col("status")))
    bucket = F.split_part("source", F.lit(":"), F.lit(1))
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b, _ in V.COVERAGE_BUCKETS]
    per_entity = issues.withColumn("bucket", bucket).groupBy(*run_keys, "entity_id").agg(*counts)
    totals = per_entity.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("impacted"), *[F.sum(b).alias(b) for b, _ in V.COVERAGE_BUCKETS]
    )
    parts = F.array_compact(
        F.array(*[F.when(F.col(b) > 0, F.format_string(label + " %d", b)) for b, label in V.COVERAGE_BUCKETS])
    )
    text = F.concat(
        F.format_string("• Coverage note: partial scrape failures/skips affected %d competitor(s) (", "impacted"),
        F.array_join(parts, ", "),
        F.lit("); review coverage before treating the run as complete."),
    )
    return totals.select(*run_keys, text.alias("bullet"))


def issue_text(source: Column, status: Column, note: Column) -> Column:
    """A failed or skipped source as one digest line."""
    failed = status == "failed"
    return F.concat(
        F.when(failed, F.lit(":warning:")).otherwise(F.lit(":information_source:")),
        F.lit(" *"), source_label(source, digest=True), F.lit(":* "),
        F.when(failed, F.lit("failed")).otherwise(F.lit("skipped")),
        F.coalesce(F.concat(F.lit(" ("), blank_to_null(note), F.lit(")")), F.lit("")),
    )


def issue_lines(statuses: DataFrame, prefix: str) -> DataFrame:
    """Digest lines of the open sources of one kind."""
    kept = statuses.filter(F.col("source").startswith(prefix) & is_open(F.col("status")))
    return kept.withColumn("line", issue_text(F.col("source"), F.col("status"), F.col("note")))


def sources_json(sources: Column) -> Column:
    """``{"status": {...}, "notes": {...}}`` of an ordered source array."""
    notes = F.filter(sources, lambda s: s["note"].isNotNull())
    status_map = F.map_from_entries(F.transform(sources, lambda s: F.struct(s["source"], s["status"])))
    note_map = F.map_from_entries(F.transform(notes, lambda s: F.struct(s["source"], s["note"])))
    return F.to_json(F.struct(status_map.alias("status"), note_map.alias("notes")))


def log_run(metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """One run-log row per entity, with its counts and source statuses."""
    joined = sources.join(metrics, "entity_id", "left")
    counts = ["new_ads_count", "new_posts_count", "pages_changed_count"]
    return joined.select(
        "entity_id", F.lit("success").alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        sources_json(F.col("sources")).alias("sources_json"),
    )


def log_outcomes(outcomes: DataFrame, metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Run-log rows of all entities that a run has tried, failed ones included.

    ``outcomes`` has run_id, entity_id, error and duration_seconds, one row per entity. An entity with an error has
    status ``error``, the message, no counts and no sources; an entity of which no source reported has no sources.
    """
    failed = has_error(F.col("error"))
    counts = ["new_ads_count", "new_posts_count", "pages_changed_count"]
    rows = outcomes.select("run_id", "entity_id", "error", "duration_seconds")
    rows = rows.join(metrics.select("entity_id", *counts), "entity_id", "left").join(sources.select("entity_id", "sources"), "entity_id", "left")
    return rows.select(
        "run_id", "entity_id", F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, F.col("error")).alias("error_message"), "duration_seconds",
        *[F.when(failed, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in counts],
        F.when(~failed & F.col("sources").isNotNull(), sources_json(F.col("sources"))).alias("sources_json"),
    )
