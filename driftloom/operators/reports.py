"""Summaries per entity and run: evidence, fallbacks, cards and executive bullets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.predicates import is_non_material, is_pricing_callout
from driftloom.functions.summaries import append_bullet, card, ensure_pricing, signal_line
from driftloom.functions.text import first_present, head, let, sanitize, truncate, truncate_phrase
from driftloom.operators.fetch import fetch, latest_ids
from driftloom.operators.posts import top_n
from driftloom.operators.segments import SEGMENT_ROWS, running_sum


# Item caps per summary type: evidence items, characters each, fallback characters (fixed values).
EVIDENCE_CAPS = {
    "linkedin_ads": (10, 500, 100),
    "linkedin_organic": (12, 600, 110),
    "twitter_activity": (12, 500, 110),
    "facebook_activity": (12, 500, 110),
    "facebook_reviews": (10, 400, 110),
    "twitter_social": (10, 400, 110),
    "facebook_social": (10, 400, 110),
    "pricing_research": (8, None, None),
    "reddit_discussion": (8, None, None),
    "jobs": (30, None, None),
}
FORUM_TYPES = ("pricing_research", "reddit_discussion")
PAGE_CHARS = 3000
HEADLINES = {  # text before a summary, by summary type (fixed values)
    "linkedin_ads": "*%d new ad(s) detected*\n",
    "linkedin_organic": "*%d new post(s) in last 7 days*\n",
}
ALTERNATE_PREFIX = {
    "apidirect_linkedin": "*LinkedIn (via API Direct)*\n",
    "apidirect_reddit": "*Reddit (via API Direct)*\n",
}


# --- Items to summaries ---------------------------------------------------------------------


def entry_text(kind: str, item: Column, n: Column) -> Column:
    """One evidence entry; ``n`` is its 1-based number."""
    number = n.cast("string")
    body = item["text"] if kind in ("linkedin_ads", "linkedin_organic") else first_present(item["text"], item["title"])
    if kind in FORUM_TYPES:
        comments = F.transform(head(item["comments"], 6), lambda c: F.concat(F.lit("- "), sanitize(c)))
        block = F.concat(F.lit("Top comments:\n"), F.array_join(comments, "\n"), F.lit("\n"))
        return F.concat(
            F.lit("\n---\nDate: "), item["date"], F.lit("  |  Subreddit: r/"), sanitize(item["channel"]),
            F.lit("\nTitle: "), sanitize(item["title"]),
            F.lit("\nURL: "), sanitize(item["url"]),
            F.lit("\nPost body:\n"), sanitize(item["text"]), F.lit("\n"),
            F.when(F.size(item["comments"]) > 0, block).otherwise(F.lit("")),
        )
    if kind == "jobs":
        return F.concat(F.lit("- "), sanitize(item["text"]))
    cut = truncate(sanitize(F.coalesce(body, F.lit(""))), EVIDENCE_CAPS[kind][1])
    if kind == "linkedin_ads":
        duration = F.concat(F.lit("\nDuration: "), sanitize(item["date"]))
        shown = F.when(F.coalesce(item["date"], F.lit("")) != "", duration).otherwise(F.lit(""))
        return F.concat(F.lit("Ad "), number, F.lit(":\n"), cut, shown)
    when = sanitize(
        first_present(item["date"], F.lit("unknown date"))
        if kind == "linkedin_organic" else F.coalesce(item["date"], F.lit("unknown date"))
    )
    url = sanitize(
        first_present(item["url"], F.lit("n/a"))
        if kind == "linkedin_organic" else F.coalesce(item["url"], F.lit("n/a"))
    )
    label = {"twitter_activity": "Tweet ", "facebook_reviews": "Review "}.get(kind, "Post ")
    author = (
        F.concat(F.lit(" by "), sanitize(F.coalesce(item["author"], F.lit("unknown"))))
        if kind.endswith("_social") else F.lit("")
    )
    text = F.concat(F.lit(label), number, author, F.lit(" ("), when, F.lit("):\n"), cut)
    return text if kind == "facebook_reviews" else F.concat(text, F.lit("\nURL: "), url)


def within_budget(entries: Column, cap: int) -> Column:
    """Leading entries whose lengths add up to at most ``cap``, joined."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def step(acc: Column, entry: Column) -> Column:
        take = acc["open"] & (F.length(acc["text"]) + F.length(entry) <= cap)
        return F.struct(
            F.when(take, F.concat(acc["text"], entry)).otherwise(acc["text"]).alias("text"), take.alias("open")
        )

    return F.aggregate(entries, start, step, lambda acc: acc["text"])


def top_items(items: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` items per group as one ordered array, with the group's full count.

    Groups may be of any size: the count is a combined aggregation and the items are limited before
    they are shuffled, so no group is ever collected whole.
    """
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_count"))
    fields = [c for c in items.columns if c not in keys]
    best = top_n(items, keys, order, n).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", F.struct(*fields).alias("item")))).alias("_items")
    )
    return best.join(counts, keys).withColumn("items", F.transform("_items", lambda x: x["item"])).drop("_items")


def evidence_text(kind: str, items: Column) -> Column:
    """The text that stands for a group's leading items, within the caps of its summary type."""
    entries = F.transform(head(items, EVIDENCE_CAPS[kind][0]), lambda x, i: entry_text(kind, x, i + 1))
    if kind in FORUM_TYPES:
        return let(
            within_budget(entries, V.POST_BUDGET),
            lambda t: F.when(t == "", F.lit("None available")).otherwise(t),
        )
    return F.array_join(entries, "\n" if kind == "jobs" else "\n\n")


def by_kind(kind: Column, build: Callable[[str], Column], kinds: Iterable[str] = EVIDENCE_CAPS) -> Column:
    """``build(k)`` for the summary type each row names."""
    out = F
    for k in kinds:
        out = out.when(kind == k, build(k))
    return out


def evidence_packets(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Evidence of every group and summary type (column ``kind``) in one pass over the items."""
    most = max(n for n, _, _ in EVIDENCE_CAPS.values())
    grouped = top_items(items, [*keys, "kind"], order, most)
    text = by_kind(F.col("kind"), lambda k: evidence_text(k, F.col("items")))
    return grouped.select(*keys, "kind", "item_count", text.alias("evidence"))


def page_evidence(changed: DataFrame) -> DataFrame:
    """Old and new page text, cut, for each changed page."""
    return changed.withColumns(
        {c: truncate(sanitize(F.col(c)), PAGE_CHARS) for c in ("old_text", "new_text")}
    )


def fallback_text(kind: str, items: Column, count: Column) -> Column:
    """Extractive summary of a group's first items."""
    if kind == "page_change":
        return F.lit("• Content changed (summary unavailable)")
    if kind == "jobs":
        return F.concat(
            F.format_string("%d new job posting(s): ", count),
            F.array_join(F.transform(head(items, 5), lambda x: x["text"]), ", "),
        )

    def line(x: Column) -> Column:
        if kind in FORUM_TYPES:
            return F.concat(x["title"], F.lit(" ("), x["url"], F.lit(")"))
        text = x["text"] if kind in ("linkedin_ads", "linkedin_organic") else first_present(x["text"], x["title"])
        return truncate(F.coalesce(text, F.lit("")), EVIDENCE_CAPS[kind][2])

    return F.concat(F.lit("• "), F.array_join(F.transform(head(items, 3), line), "\n• "))


def page_change_text(page_type: Column, items: Column) -> Column:
    """Extractive summary of a changed page; a careers page names the jobs that its capture brought as new (null: none)."""
    jobs = fallback_text("jobs", F.transform(items, lambda t: F.struct(t.alias("text"))), F.size(items))
    named = F.when((page_type == "careers") & (F.size(items) > 0), F.concat(F.lit("\n\n_New jobs:_ "), jobs))
    return F.concat(fallback_text("page_change", F.lit(None), F.lit(0)), F.coalesce(named, F.lit("")))


def summarize(items: DataFrame, keys: list[str], order: list, kind: str,
              fn: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Summary text per group of new items.

    ``fn`` builds it from the group's leading items (an array within the caps of the summary type)
    and its full count; pass a pandas UDF over the array to call out to a model. Without ``fn`` the
    extractive fallback is used.
    """
    grouped = top_items(items, keys, order, EVIDENCE_CAPS[kind][0])
    build = fn or (lambda rows, count: fallback_text(kind, rows, count))
    return grouped.select(*keys, "item_count", build(F.col("items"), F.col("item_count")).alias("summary_text"))


def headline(kind: str, platform: Column, count: Column) -> Column:
    """New-item headline of a summary type, or the prefix of an alternate feed."""
    own = F.format_string(HEADLINES[kind], count) if kind in HEADLINES else F.lit("")
    return F.coalesce(*[F.when(platform == p, F.lit(t)) for p, t in ALTERNATE_PREFIX.items()], own)


def summaries_by_kind(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Headed fallback summaries of every group, ``platform`` and ``kind``, in one pass."""
    grouped = top_items(items, [*keys, "platform", "kind"], order, 5)
    text = by_kind(
        F.col("kind"),
        lambda k: F.concat(
            headline(k, F.col("platform"), F.col("item_count")),
            fallback_text(k, F.col("items"), F.col("item_count")),
        ),
    )
    return grouped.select(*keys, "platform", "kind", "item_count", text.alias("summary_text"))


def summarize_groups(items: DataFrame, keys: list[str], order: list[str],
                     fn: Callable[[dict, Iterator[pa.RecordBatch]], str | None]) -> DataFrame:
    """keys, item_count and summary_text: a caller's own summary of all items of each group.

    ``fn`` gets the group's key and its items, in order, as Arrow batches that are read from Spark as it asks for them
    (rows at once: spark.sql.execution.arrow.maxRecordsPerBatch); what it leaves is counted and passed over. So a task
    holds one batch, however large the group is: Spark sorts the rows, on disk where they do not fit. Null keys
    are a group. ``fn`` may give None.
    """
    types = dict(items.dtypes)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            start = 0
            for key, same in groupby(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
                n = sum(1 for _ in same)
                yield key, batch.slice(start, n)
                start += n

    def counted(parts: Iterator[tuple[tuple, pa.RecordBatch]], tally: list[int]) -> Iterator[pa.RecordBatch]:
        for _, part in parts:
            tally[0] += part.num_rows
            yield part

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in groupby(slices(batches), itemgetter(0)):
            _, first = next(parts)
            tally = [0]
            feed = counted(chain([(key, first)], parts), tally)
            text = fn(dict(zip(keys, key, strict=True)), feed)
            for _ in feed:  # what was not read
                pass
            named = [first.slice(0, 1).column(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*named, pa.array(tally, pa.int64()), pa.array([text], pa.string())], [*keys, "item_count", "summary_text"]
            )

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "item_count bigint", "summary_text string"])
    return items.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def told_summaries(items: DataFrame, keys: list[str], order: list[str],
                   fn: Callable[[dict, Iterator[pa.RecordBatch]], str | None]) -> DataFrame:
    """Headed summaries as :func:`summaries_by_kind` has them, told by ``fn``; where it gives None, the fallback stays."""
    group = [*keys, "platform", "kind"]
    told = summarize_groups(items, group, order, fn).withColumnRenamed("summary_text", "_told").drop("item_count")
    headed = by_kind(F.col("kind"), lambda k: F.concat(headline(k, F.col("platform"), F.col("item_count")), F.col("_told")))
    joined = summaries_by_kind(items, keys, order).join(told, group, "left")
    return joined.withColumn("summary_text", F.coalesce(headed, F.col("summary_text"))).drop("_told")


def prefix_budget(df: DataFrame, keys: list[str], order: str, length: Column, cap: int,
                  width: int = SEGMENT_ROWS) -> DataFrame:
    """Rows taken in order until one would exceed ``cap`` characters in total, with ``running``.

    Only lengths go through the window; the texts of the rows taken are fetched by (key, order), which is unique.
    """
    narrow = df.select(*keys, order, length.cast("bigint").alias("_length"))
    summed = running_sum(narrow, keys, order, F.col("_length"), "running", False, width)
    taken = summed.filter(F.col("running") <= cap).select(*keys, order, "running")
    return fetch(df, taken, [*keys, order]).select(*df.columns, "running")


# --- Reports --------------------------------------------------------------------------------


def entity_report(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Latest summary of every type as one wide row."""
    key = [*keys, "summary_type"]
    rows = summaries.select(*key, "id", "summary_text")
    last = fetch(rows, latest_ids(rows, key, "id"), [*key, "id"])
    # One text of each known type, of texts with the same id the greatest; keys with other types only have a row of nulls.
    known = F.when(F.col("summary_type").isin(*V.SUMMARY_COLUMNS), F.struct("summary_type", "summary_text"))
    texts = last.groupBy(*keys).agg(F.collect_set(known).alias("_texts"))
    text = lambda k: F.array_max(F.filter("_texts", lambda t: t["summary_type"] == k))["summary_text"]
    return texts.select(*keys, *[text(k).alias(c) for k, c in V.SUMMARY_COLUMNS.items()])


def complete_report(reports: DataFrame) -> DataFrame:
    """Every report column present; missing ones are null."""
    wanted = [*dict.fromkeys([*V.SUMMARY_COLUMNS.values(), "coverage_summary", "error"])]
    none = F.lit(None).cast("string")
    return reports.withColumns({c: none for c in wanted if c not in reports.columns})


def name_of() -> Column:
    return first_present(F.col("name"), F.lit("Unknown"))


def evidence_block() -> Column:
    """Labelled report fields in order, blank ones dropped, each cut."""
    fields = [
        F.when(
            F.col(c) != "",
            F.concat(F.lit(f"{label}: "), truncate(sanitize(F.col(c)), V.FIELD_CHARS)),
        )
        for label, c in V.EVIDENCE_FIELDS
    ]
    return F.concat_ws("\n", *fields)


def pricing_text() -> Column:
    return first_present(F.col("pricing_research_summary"), F.col("pricing_change"))


def fallback_card() -> Column:
    """Signal card built from the report alone."""

    def point(label: str, text: Column) -> Column:
        return let(
            signal_line(text, 180),
            lambda x: F.when(x != "", F.concat(F.lit(f"- {label}: "), truncate_phrase(x, 200))),
        )

    error, coverage = signal_line(F.col("error"), 180), F.col("coverage_summary")
    points = [
        point("Pricing/packaging", pricing_text()),
        point("Messaging/GTM", first_present(*[F.col(c) for c in V.CARD_MESSAGING])),
        point("Coverage risk", F.when(error != "", F.col("error")).otherwise(coverage)),
    ]
    return card(sanitize(name_of()), F.array_compact(F.array(*points)))


def pricing_callout() -> Column:
    """The pricing bullet of a report; null if no pricing signal of it is a material callout."""
    candidates = F.array("pricing_research_summary", "pricing_change")
    lines = F.transform(candidates, lambda c: signal_line(c, 150))
    good = F.filter(lines, lambda x: (x != "") & ~is_non_material(x) & is_pricing_callout(x))
    return F.concat(
        F.lit("• "), name_of(), F.lit(" pricing update: "), F.regexp_replace(F.get(good, F.lit(0)), r"[. ]+$", ""), F.lit(".")
    )


def pricing_bullet(reports: DataFrame, run_keys: list[str], position: str) -> DataFrame:
    """Per run, the first entity whose pricing signal is a material callout."""
    found = reports.select(*run_keys, position, pricing_callout().alias("_bullet")).filter(F.col("_bullet").isNotNull())
    return found.groupBy(*run_keys).agg(F.min_by("_bullet", position).alias("pricing_bullet"))


def executive_signals(reports: DataFrame, run_keys: list[str], position: str) -> DataFrame:
    """Per run: ``executive``, the first pricing, messaging and risk signal, and ``pricing_bullet`` as above.

    An entity with a risk contributes only the risk. Each signal is a combined minimum over
    positions, so a run may hold any number of entities; all of them come from one pass over the reports.
    """
    risk = signal_line(first_present(F.col("error"), F.col("coverage_summary")), 120)
    price = signal_line(pricing_text(), 140)
    message = signal_line(first_present(*[F.col(c) for c in V.EXEC_MESSAGING]), 140)
    marked = reports.select(
        *run_keys, position, name_of().alias("_name"),
        risk.alias("_risk"), price.alias("_price"), message.alias("_message"), pricing_callout().alias("_bullet"),
    )

    def first(col: str, ok: Column) -> Column:
        text = F.concat("_name", F.lit(": "), F.col(col))
        return F.min(F.when(ok & (F.col(col) != ""), F.struct(F.col(position), text.alias("text"))))["text"]

    calm = F.col("_risk") == ""
    found = marked.groupBy(*run_keys).agg(
        first("_price", calm).alias("_p"), first("_message", calm).alias("_m"), first("_risk", F.lit(True)).alias("_r"),
        F.min_by("_bullet", F.when(F.col("_bullet").isNotNull(), F.col(position))).alias("pricing_bullet"),
    )
    bullets = F.concat_ws(
        "\n",
        F.concat(F.lit("• *Pricing watch:* "), "_p"),
        F.concat(F.lit("• *Messaging shift:* "), "_m"),
        F.concat(F.lit("• *Execution risk:* "), "_r"),
    )
    return found.select(*run_keys, first_present(bullets, F.lit(V.NO_CHANGES)).alias("executive"), "pricing_bullet")


def executive_summary(runs: DataFrame, reports: DataFrame, run_keys: list[str], position: str) -> DataFrame:
    """Executive bullets of every run, pricing first; runs without entities say so."""
    joined = runs.select(*run_keys).join(executive_signals(reports, run_keys, position), run_keys, "left")
    text = ensure_pricing(F.col("executive"), F.col("pricing_bullet"), 6)
    return joined.select(
        *run_keys,
        F.when(F.col("executive").isNull(), F.lit(V.NO_ENTITIES)).otherwise(text).alias("executive"),
    )


def card_evidence(reports: DataFrame, run_keys: list[str], position: str) -> DataFrame:
    """Leading signal cards of each run within the executive budget.

    A card has at least 34 characters, so no more than budget/34 cards can fit: limiting to that
    many first loses nothing and keeps a huge run out of one task.
    """
    shortest = len("Competitor: \nSignals:\n") + len("- x: y") + 6
    most = V.CARD_BUDGET // shortest + 1
    cards = reports.select(*run_keys, F.col(position).alias("_pos"), sanitize(fallback_card()).alias("card"))
    leading = top_n(cards, run_keys, ["_pos"], most)
    return prefix_budget(leading, run_keys, "_rank", F.length("card"), V.CARD_BUDGET).select(
        *run_keys, F.col("_pos").alias(position), "card", F.col("running")
    )


def recovery_run(entities: DataFrame, statuses: DataFrame, reports: DataFrame, executive: DataFrame) -> DataFrame:
    """A repeat of the sign-in sources only, for entities that have an id.

    ``executive`` has run_id and executive; a note is added when the repeat found nothing new.
    """
    chosen = entities.filter(F.col("network_id") != "").select("entity_id")
    kept = statuses.filter(F.col("source").isin("linkedin:ads", "linkedin:organic"))
    tried = kept.join(chosen, "entity_id", "left_semi").select("run_id", "entity_id").distinct()
    has_new = (F.coalesce(F.col("linkedin_ads_summary"), F.lit("")) != "") | (
        F.coalesce(F.col("linkedin_organic_summary"), F.lit("")) != ""
    )
    found = tried.join(reports, ["run_id", "entity_id"], "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entities"), F.bool_or(F.coalesce(has_new, F.lit(False))).alias("has_new")
    )
    joined = executive.join(found, "run_id")
    note = F.when(~F.col("has_new"), F.lit(V.NO_NET_NEW))
    return joined.select(
        "run_id", "entities", "has_new", append_bullet(F.col("executive"), note, 4).alias("executive")
    )
