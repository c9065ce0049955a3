"""The weekly run from changes to the digest, for all entities at once; README.md lists which steps are open."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.summaries import append_bullet
from driftloom.operators import coverage as C
from driftloom.operators import digest as D
from driftloom.operators import reports as R
from driftloom.operators import state as S
from driftloom.sources.tables import written


@dataclass
class WeeklyResult:
    changes: DataFrame
    fresh_items: DataFrame
    item_state: DataFrame
    summaries: DataFrame
    reports: DataFrame
    executive: DataFrame
    blocks: DataFrame
    evidence: DataFrame | None = None


def weekly_run(
    entities: DataFrame,
    captures: DataFrame,
    page_state: DataFrame | None,
    observed: DataFrame,
    item_state: DataFrame,
    status_events: DataFrame,
    summary_types: dict[str, str],
    run_date: str,
    summary_only: bool = True,
    summarize: Callable[[dict, Iterator[pa.RecordBatch]], str | None] | None = None,
    snapshots: DataFrame | None = None,
) -> WeeklyResult:
    """Captures and sightings of one run to changes, new items, summaries, report and digest.

    ``entities`` has run_id, entity_id, position, name and website_url; ``observed`` items carry
    title, text, url, date, author and comments; ``summary_types`` maps a platform to its summary
    type. Nothing is collected. What several later steps read (changes, new items, statuses, reports)
    is written once to the shared folder, so it is neither computed twice nor lost with an executor.
    ``summarize`` tells the new items of an entity, platform and kind (see ``summarize_groups``). With the stored
    ``snapshots`` the result has ``evidence``: old and new text of every changed page.
    """
    keys = ["run_id", "entity_id"]
    runs = entities.select("run_id").distinct()
    changes = written(S.first_scan_note(S.detect_changes(captures, page_state)), "changes")
    fresh = written(S.new_items(observed, item_state), "new-items")
    statuses = written(C.source_status(status_events, keys), "statuses")

    kinds = F.create_map(*[F.lit(x) for pair in summary_types.items() for x in pair])
    typed = fresh.withColumn("kind", F.try_element_at(kinds, "platform")).filter(F.col("kind").isNotNull())
    by_kind = R.told_summaries(typed, keys, ["seq"], summarize) if summarize else R.summaries_by_kind(typed, keys, ["seq"])
    from_items = by_kind.select(
        *keys, F.col("kind").alias("summary_type"), "summary_text",
        F.when(F.col("platform").isin(*R.ALTERNATE_PREFIX), F.lit(1)).otherwise(F.lit(2)).alias("id"),
    )
    page_kind = F.concat("page_type", F.lit("_change")).alias("summary_type")
    from_pages = changes.filter(F.col("verdict") == "changed").select(
        *keys, page_kind, R.page_change_text(F.col("page_type"), F.col("items")).alias("summary_text"),
        F.lit(2).alias("id"),
    )
    summaries = from_pages.unionByName(from_items)
    notes = changes.filter(F.col("note").isNotNull()).select(
        *keys, page_kind, F.col("note").alias("summary_text"), F.lit(0).alias("id")
    )
    # A change outranks the page's first-scan note, an entity's own feed the alternate one.
    ranked = written(summaries.unionByName(notes), "summaries")
    reports = written(
        R.complete_report(
            entities.join(R.entity_report(ranked, keys), keys, "left")
            .join(C.source_lists(statuses, keys), keys, "left")
            .join(C.coverage_summary(statuses, keys), keys, "left")
        ),
        "reports",
    )
    executive = (
        R.executive_summary(runs, reports, ["run_id"], "position")
        .join(C.coverage_bullet(statuses, ["run_id"]), "run_id", "left")
        .select("run_id", append_bullet(F.col("executive"), F.col("bullet"), 6).alias("executive"))
    )
    blocks = D.digest_blocks(
        reports, executive.withColumn("run_date", F.lit(run_date)), "position", summary_only
    )
    evidence = None if snapshots is None else R.page_evidence(S.changed_texts(changes, captures, snapshots))
    return WeeklyResult(
        changes, fresh, S.upsert_items(item_state, observed), summaries.drop("id"), reports, executive, blocks, evidence
    )
