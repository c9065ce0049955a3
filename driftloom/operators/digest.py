"""Digest blocks and their packing into messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.text import let
from driftloom.functions.summaries import compact_bullets, fit_bullets, truncate_block
from driftloom.operators.coverage import is_open, issue_text
from driftloom.operators.segments import running_sum, segment_of
from driftloom.sources.tables import written

PAGE_SECTIONS = [
    ("Homepage", "homepage_change"), ("Blog", "blog_change"),
    ("Pricing", "pricing_change"), ("Careers", "careers_change"),
]
FORUM_SECTIONS = [  # (title, report column, source whose issue stands in)
    ("*Pricing Intel (Reddit):*", "pricing_research_summary", "reddit:pricing"),
    ("*Reddit Customer Voice:*", "reddit_discussion_summary", "reddit:discussion"),
]
NETWORK_SECTIONS = [  # (title, report column, source, text without news)
    ("*LinkedIn Ads:*", "linkedin_ads_summary", "linkedin:ads", "No new ads"),
    ("*LinkedIn Organic:*", "linkedin_organic_summary", "linkedin:organic", "No new posts in last 7 days"),
]
SOCIAL_SECTIONS = [
    ("*Twitter:*", "twitter_summary"),
    ("*Twitter Commentary (third-party):*", "twitter_social_summary"),
    ("*Facebook:*", "facebook_summary"),
    ("*Facebook Reviews:*", "facebook_reviews_summary"),
    ("*Facebook Commentary (third-party):*", "facebook_social_summary"),
]
FOOTER = "_Generated by driftloom · Edit the entity registry to add or remove entities_"
SEGMENT_BLOCKS = 100_000


# Blocks stay raw (kind, title, body, style) until they are rows: counting and numbering them then
# costs nothing, and the text rules run once per block.


def block(kind: str, body: Column | None = None, title: Column | None = None, style: str = "plain") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), (none if title is None else title).alias("title"),
        (none if body is None else body).alias("body"), F.lit(style).alias("style"),
    )


def block_text() -> Column:
    """Final text of a raw block row."""
    body, style = F.col("body"), F.col("style")
    executive = let(compact_bullets(body, 6, 380), lambda b: fit_bullets(b, V.BLOCK_CHARS))
    shown = F.when(style == "bullets", compact_bullets(body, 3, 220)).when(style == "executive", executive).otherwise(body)
    titled = let(F.concat("title", F.lit("\n"), shown), truncate_block)
    return F.when(style == "plain", body).otherwise(titled)


def _has(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) != ""


def _entry(name: Column) -> Column:
    return F.get(F.filter("sources", lambda s: s["source"] == name), F.lit(0))


def _issue(entry: Column) -> Column:
    return F.when(is_open(entry["status"]), issue_text(entry["source"], entry["status"], entry["note"]))


def _page_blocks() -> Column:
    pages = F.array(*[F.struct(F.lit(f"*{t}:*").alias("title"), F.col(c).alias("text")) for t, c in PAGE_SECTIONS])
    shown = F.filter(pages, lambda p: p["text"] != "")
    return F.transform(shown, lambda p: block("section", p["text"], p["title"], "titled"))


def _website_blocks() -> Column:
    website = F.filter("sources", lambda s: s["source"].startswith("website:"))
    issues = F.filter(F.transform(website, _issue), lambda x: x.isNotNull())
    quiet = F.when(
        F.size(website) > 0, F.lit(":white_check_mark: *Website:* No changes detected this week")
    ).otherwise(F.lit("*Website:* Not configured"))
    changed = _has(PAGE_SECTIONS[0][1])
    for _, col in PAGE_SECTIONS[1:]:
        changed = changed | _has(col)
    coverage = block("section", F.array_join(issues, "\n"), F.lit("*Website Coverage:*"), "titled")
    line = F.when(F.size(issues) > 0, coverage).when(~changed, block("section", quiet))
    return F.array_compact(F.array(line))


def _summary_blocks() -> Column:
    """Summaries in order, or what stands in for a missing one."""
    none = F.lit(None).cast("string")

    def row(title: str, col: str, source: str | None = None, idle: str | None = None) -> Column:
        return F.struct(
            F.lit(title).alias("title"), F.col(col).alias("text"),
            (none if source is None else F.lit(source)).alias("source"),
            (none if idle is None else F.lit(idle)).alias("idle"),
        )

    sections = [row(t, c, s) for t, c, s in FORUM_SECTIONS]
    sections += [row(t, c, s, i) for t, c, s, i in NETWORK_SECTIONS]
    sections += [row(t, c) for t, c in SOCIAL_SECTIONS]

    def stand_in(s: Column) -> Column:
        """The source's issue, or that there is no news."""

        def pick(entry: Column) -> Column:
            issue = _issue(entry)
            unset = F.when(entry["status"] == "not_configured", F.concat(s["title"], F.lit(" Not configured")))
            idle = F.concat(s["title"], F.lit(" "), s["idle"])
            quiet = block("section", F.coalesce(unset, issue, idle))
            titled = F.when(issue.isNotNull(), block("section", issue, s["title"], "titled"))
            return F.when(s["idle"].isNull(), titled).otherwise(quiet)

        return let(_entry(s["source"]), pick)

    def section(s: Column) -> Column:
        summary = block("section", s["text"], s["title"], "bullets")
        return F.when(F.coalesce(s["text"], F.lit("")) != "", summary).otherwise(stand_in(s))

    return F.filter(F.transform(F.array(*sections), section), lambda x: x.isNotNull())


def entity_blocks() -> Column:
    """The blocks of one entity: header, page changes, summaries or the reason they are missing."""
    top = block("section", F.format_string("*%s*  |  <%s|%s>", "name", "website_url", "website_url"))
    failed = block("section", F.concat(F.lit(":warning: *Error:* "), "error"))
    return F.when(_has("error"), F.array(top, failed, block("divider"))).otherwise(
        F.concat(F.array(top), _page_blocks(), _website_blocks(), _summary_blocks(), F.array(block("divider")))
    )


def digest_blocks(reports: DataFrame, runs: DataFrame, position: str, summary_only: bool = False) -> DataFrame:
    """All blocks of every run's digest, numbered from 0.

    ``reports`` are complete entity reports with ``sources``; ``runs`` has run_id, run_date and
    executive. Block numbers come from a running sum of block counts, not from sorting all blocks.
    """
    opening = F.array(
        block("header", F.concat(F.lit("Weekly Competitive Intel — "), "run_date")), block("divider")
    )
    summary = block("section", F.col("executive"), F.lit("*Executive Summary:*"), "executive")
    footer = F.array(block("context", F.lit(FOOTER)))
    closing = F.when(_has("executive"), F.concat(F.array(summary, block("divider")), footer)).otherwise(footer)
    if summary_only:
        arrays = runs.select("run_id", F.lit(0).cast("bigint").alias("start"), F.concat(opening, closing).alias("blocks"))
    else:
        counted = reports.select("run_id", position, entity_blocks().alias("blocks")).withColumn("_size", F.size("blocks"))
        counted = written(counted, "counted-blocks")
        starts = running_sum(counted.select("run_id", position, "_size"), ["run_id"], position, F.col("_size"), "start", True)
        placed = counted.join(starts.select("run_id", position, "start"), ["run_id", position])
        totals = counted.groupBy("run_id").agg(F.sum("_size").alias("_total"))
        after = F.coalesce("_total", F.lit(0)) + 2
        frame = F.array(
            F.struct(F.lit(0).cast("bigint").alias("start"), opening.alias("blocks")),
            F.struct(after.cast("bigint").alias("start"), closing.alias("blocks")),
        )
        ends = runs.join(totals, "run_id", "left").select("run_id", F.explode(frame).alias("_f"))
        arrays = placed.select("run_id", (F.col("start") + 2).alias("start"), "blocks").unionByName(
            ends.select("run_id", "_f.start", "_f.blocks")
        )
    rows = arrays.select("run_id", "start", F.posexplode("blocks").alias("_i", "_block"))
    raw = rows.select("run_id", (F.col("start") + F.col("_i")).alias("block_no"), "_block.*")
    return raw.select("run_id", "block_no", "kind", block_text().alias("text"))


# --- Packing --------------------------------------------------------------------------------
#
# Where a message starts decides where the next one starts, so packing is a chain along the whole
# digest. A chain enters a segment of blocks at one of its first ``size`` positions, because no
# message is longer; so each segment is summarised, independently, as a table from entry position
# to exit position and message count. Such tables can be composed, two neighbours at a time, so
# every segment's true entry is known after a few joins whose number is the logarithm of the
# segments; then the segments assign messages independently.
#
# A digest may also be short, and there may be very many: rows are sorted by segment and read in
# Arrow batches, and all segments that a batch brings are worked on at once. Positions then count
# the rows at hand, and every row is told the bounds of its segment.


def borders(rows: pa.Table) -> np.ndarray:
    """Where a segment begins, in rows that are sorted by run and segment."""
    changed = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for key in ("run_id", "segment"):
        differs = pc.not_equal(rows.column(key).slice(1), rows.column(key).slice(0, len(changed)))
        changed |= pc.fill_null(differs, True).to_numpy()
    return np.flatnonzero(np.concatenate([[True], changed]))


def whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole segments, those of many short ones at a time; the last one of a batch waits for its end."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            at = int(borders(rows)[-1])
            if at:
                yield rows.slice(0, at)
            held = [rows.slice(at)]
    yield from held


def spans(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row, where its segment begins, where the segment's own rows end, and where those ahead of them end."""
    begin = borders(rows)
    sizes = np.diff(np.append(begin, rows.num_rows))
    own = np.add.reduceat((~rows.column("ahead").to_numpy()).astype(np.int64), begin)
    return np.repeat(begin, sizes), np.repeat(begin + own, sizes), np.repeat(begin + sizes, sizes)


def next_start(divider: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """For every position, where the following message starts if one starts here.

    A message takes at most ``size`` blocks and ends after the last divider that is not its first
    block; without one it is cut hard. No message goes beyond its segment's ``stop``.
    """
    start = np.arange(len(divider))
    last = np.maximum.accumulate(np.where(divider, start, -1))
    end = start + size
    cut = last[np.minimum(end, stop) - 1]
    following = np.where(cut > start, cut + 1, end)
    return np.where(end >= stop, stop, following)


def chains(following: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, where the chain from it leaves the segment's rows before ``own``, and after how many messages.

    Every round puts each position's way and that of where it has got to together, so ways double in length.
    """
    at, messages = following.copy(), np.ones(len(following), dtype=np.int64)
    inside = at < own
    while inside.any():
        to = at[inside]
        messages[inside] += messages[to]
        at[inside] = at[to]
        inside = at < own
    return at, messages


def chains_from(entries: np.ndarray, following: np.ndarray, own: np.ndarray) -> np.ndarray:
    """All positions before ``own`` at which messages start, from each segment's first one on, in no order."""
    jumps = [following]
    while (jumps[-1] < own).any():
        last = jumps[-1]
        jumps.append(np.where(last < own, last[np.minimum(last, len(last) - 1)], last))
    found = entries
    for jump in reversed(jumps):
        more = jump[found]
        found = np.concatenate([found, more[more < own[found]]])
    return found


def _segment_tables(rows: pa.Table, size: int) -> pa.Table:
    begin, own, stop = spans(rows)
    leaves, messages = chains(next_start(rows.column("divider").to_numpy(), stop, size), own)
    place = np.arange(rows.num_rows)
    first = place < np.minimum(begin + size, own)
    values = {"entry": place - begin, "leaves": leaves - own, "messages": messages}
    keys = rows.select(["run_id", "segment"]).filter(pa.array(first))
    return pa.table({**dict(zip(keys.column_names, keys.columns)), **{k: v[first] for k, v in values.items()}})


def _assigned(rows: pa.Table, size: int) -> pa.Table:
    begin, own, stop = spans(rows)
    following = next_start(rows.column("divider").to_numpy(), stop, size)
    place = np.arange(rows.num_rows)
    entry = begin + rows.column("entry").to_numpy()
    starts = np.zeros(rows.num_rows + 1, dtype=np.int64)
    starts[chains_from(np.flatnonzero((place == entry) & (place < own)), following, own) + 1] = 1
    started = np.cumsum(starts)
    number = started[1:] - started[begin] + rows.column("message").to_numpy() - 1
    kept = rows.select(["run_id", "block_no"]).append_column("message_no", pa.array(number))
    return kept.filter(pa.array(place < own))


def segment_entries(tables: DataFrame, first: DataFrame, segments: int) -> DataFrame:
    """run_id, segment, entry, message: where the chain enters each segment, and after how many messages.

    Tables of neighbours are joined into tables of 2, 4, 8, ... segments. From the widest down, the known entry of a
    stretch then gives that of its second half. ``first`` has the entries of the first segments; segments behind a
    run's last one may be named, too. Every join is on run, segment and position, so no task sees a whole run.
    """
    levels = [tables] if segments > 1 else []
    while levels and 1 << len(levels) < segments:
        width = 1 << (len(levels) - 1)
        place = F.pmod("segment", F.lit(2 * width))
        second = levels[-1].filter(place == width).select(
            "run_id", (F.col("segment") - width).alias("segment"), F.col("entry").alias("leaves"),
            F.col("leaves").alias("_leaves"), F.col("messages").alias("_messages"),
        )
        both = levels[-1].filter(place == 0).join(second, ["run_id", "segment", "leaves"])
        both = both.select(
            "run_id", "segment", "entry", F.col("_leaves").alias("leaves"), (F.col("messages") + F.col("_messages")).alias("messages")
        )
        levels.append(written(both, "packing-level"))
    known = first
    for k in reversed(range(len(levels))):
        halves = known.join(levels[k], ["run_id", "segment", "entry"]).select(
            "run_id", (F.col("segment") + (1 << k)).alias("segment"), F.col("leaves").alias("entry"),
            (F.col("message") + F.col("messages")).alias("message"),
        )
        known = written(known.unionByName(halves), "packing-entries")
    return known


def pack_blocks(blocks: DataFrame, size: int = V.MESSAGE_BLOCKS, width: int = SEGMENT_BLOCKS) -> DataFrame:
    """Message number of every block: at most ``size`` blocks each, cut after dividers.

    The blocks are written once to the shared folder: packing reads their positions and kinds, and
    only the last join reads their text.
    """
    blocks = written(blocks, "blocks")
    run_type = dict(blocks.dtypes)["run_id"]
    segment = segment_of(F.col("block_no"), width)
    flags = blocks.select("run_id", "block_no", F.col("kind").eqNullSafe("divider").alias("divider"), segment.alias("segment"))
    early = (F.col("block_no") % width < size) & (F.col("segment") > 0)
    ahead = flags.filter(early).withColumn("segment", F.col("segment") - 1)
    seen = flags.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))

    def sorted_by_segment(df: DataFrame) -> DataFrame:
        return df.repartition("run_id", "segment").sortWithinPartitions("run_id", "segment", "block_no")

    def segment_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_segments(batches):
            yield from _segment_tables(rows, size).to_batches()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_segments(batches):
            yield from _assigned(rows, size).to_batches()

    tables = sorted_by_segment(seen).mapInArrow(
        segment_tables, f"run_id {run_type}, segment bigint, entry bigint, leaves bigint, messages bigint"
    )
    segments = (blocks.agg(F.max(segment)).first()[0] or 0) + 1
    if segments > 1:
        tables = written(tables, "packing-tables")
    zero = F.lit(0).cast("bigint")
    first = blocks.filter("block_no = 0").select("run_id", zero.alias("segment"), zero.alias("entry"), zero.alias("message"))
    entries = segment_entries(tables, first, segments)
    numbered = sorted_by_segment(seen.join(entries, ["run_id", "segment"])).mapInArrow(
        assigned, f"run_id {run_type}, block_no bigint, message_no bigint"
    )
    return blocks.join(numbered, ["run_id", "block_no"])


def digest_messages(packed: DataFrame) -> DataFrame:
    """One JSON document per message, its blocks (at most 50) in order."""
    text_type = F.when(F.col("kind") == "header", F.lit("plain_text")).otherwise(F.lit("mrkdwn"))
    emoji = F.when(F.col("kind") == "header", F.lit(True))
    text = F.struct(text_type.alias("type"), F.col("text").alias("text"), emoji.alias("emoji"))
    element = F.struct(F.lit("mrkdwn").alias("type"), F.col("text").alias("text"))
    body = F.struct(
        F.col("kind").alias("type"),
        F.when(F.col("kind").isin("header", "section"), text).alias("text"),
        F.when(F.col("kind") == "context", F.array(element)).alias("elements"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block_no", body.alias("body"))))
    grouped = packed.groupBy("run_id", "message_no").agg(ordered.alias("_rows"))
    blocks = F.transform("_rows", lambda r: r["body"])
    return grouped.select(
        "run_id", "message_no", F.size("_rows").cast("bigint").alias("block_count"),
        F.to_json(F.struct(blocks.alias("blocks"))).alias("payload"),
    )
