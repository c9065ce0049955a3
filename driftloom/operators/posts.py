"""Posts and comments: filtering, first-wins dedup, ranking, enrichment and display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions import predicates as P
from driftloom.functions import vocab as V
from driftloom.functions.recency import within_days
from driftloom.functions.text import distinct_ignoring_case, first_present, head, let, strip
from driftloom.functions.weeks import epoch_date


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "_rank") -> DataFrame:
    """First ``n`` rows per key. Spark applies the limit inside every input partition before the
    shuffle, so a hot key sends at most ``n`` rows per partition."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in the given order."""
    return top_n(df, keys, order, 1).drop("_rank")


def clean_posts(df: DataFrame) -> DataFrame:
    """Posts with id, title and channel; deleted bodies become blank."""
    body = F.when(F.col("raw_body").isin(*V.DELETED_BODIES), F.lit("")).otherwise(
        F.coalesce("raw_body", F.lit(""))
    )
    present = reduce(lambda a, b: a & b, [F.col(c) != "" for c in ("post_id", "title", "channel")])
    return df.filter(present).withColumn("text", body).drop("raw_body")


def normalized(values: list[str] | None) -> list[str]:
    return sorted({v.strip().lower() for v in values or [] if v and v.strip()})


def filter_channels(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Keep allowed channels (all when the list is empty), then drop denied ones."""
    name = F.lower("channel")
    if normalized(allow):
        df = df.filter(name.isin(*normalized(allow)))
    if normalized(deny):
        df = df.filter(~name.isin(*normalized(deny)))
    return df


def filter_channels_by_entity(posts: DataFrame, entities: DataFrame) -> DataFrame:
    """The same rule with each entity's own ``include_channels`` and ``exclude_channels`` arrays."""

    def norm(col: str) -> Column:
        return F.filter(F.transform(col, lambda x: F.lower(strip(x))), lambda x: x != "")

    rules = entities.select(
        "entity_id", norm("include_channels").alias("_allow"), norm("exclude_channels").alias("_deny")
    )
    name = F.lower("channel")
    allowed = (F.size("_allow") == 0) | F.array_contains("_allow", name)
    joined = posts.join(rules, "entity_id").filter(allowed & ~F.array_contains("_deny", name))
    return joined.drop("_allow", "_deny")


def filter_posts(df: DataFrame, mode: str, allow: list[str] | None = None,
                 deny: list[str] | None = None) -> DataFrame:
    """Posts worth keeping for ``pricing`` or ``discussion``, with date and absolute URL."""
    kept = filter_channels(clean_posts(df), allow, deny).filter(~P.is_finance(F.col("channel")))
    combined = F.concat_ws(" ", "title", "text")
    signal = P.has_price_signal if mode == "pricing" else P.has_customer_signal
    return kept.filter(signal(combined)).withColumns(
        {
            "date": epoch_date(F.col("created_utc")),
            "url": F.concat(F.lit(V.FORUM_BASE), F.coalesce("permalink", F.lit(""))),
        }
    )


def exclude_own(df: DataFrame, handle: Column) -> DataFrame:
    """Drop posts written by the entity itself."""
    return df.filter(F.lower("author") != F.coalesce(F.lower(handle), F.lit("")))


def rank_comments(comments: DataFrame, mode: str, order: str = "ord") -> DataFrame:
    """The best comments per post: signal first, then neutral, in thread order; at most 8, cut."""
    if mode == "pricing":
        kept, first = comments, P.has_price_signal(F.col("body"))
    else:
        first = P.has_customer_signal(F.col("body"))
        kept = comments.filter(first | ~P.has_employee_signal(F.col("body")))
    classed = kept.withColumn("class", F.when(first, F.lit(0)).otherwise(F.lit(1)))
    best = top_n(classed, ["post_id"], ["class", order], V.MAX_COMMENTS, "rank")
    return best.withColumn("body", F.substring("body", 1, V.MAX_COMMENT_CHARS))


def comment_lists(ranked: DataFrame) -> DataFrame:
    """Ranked comments (at most 8 per post) as one ordered array per post."""
    pair = F.struct("rank", "body")
    return ranked.groupBy("post_id").agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["body"]).alias("comments")
    )


def attach_comments(posts: DataFrame, comments: DataFrame, order: list,
                    n: int = V.MAX_ENRICHED_POSTS) -> DataFrame:
    """Comments for each entity's first ``n`` posts; the others keep an empty list.

    Only the few enriched (entity, post) pairs are joined to comments; the full posts table is then
    joined once, on a key that is unique on both sides.
    """
    targets = top_n(posts, ["entity_id"], order, n).select("entity_id", "post_id")
    enriched = targets.join(comments, "post_id")
    none = F.array().cast("array<string>")
    return posts.join(enriched, ["entity_id", "post_id"], "left").withColumn(
        "comments", F.coalesce("comments", none)
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    """Append results of several searches, keeping repeats."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def select_recent(cards: DataFrame, order: str, days: int = V.MAX_RECENT_DAYS, n: int = V.MAX_CARDS) -> DataFrame:
    """Recent cards, one per item in card order, at most ``n`` per entity."""
    recent = cards.filter(within_days(F.col("label"), days, F.col("as_of")))
    return top_n(dedup_first(recent, ["entity_id", "item_id"], [order]), ["entity_id"], [order], n).drop("_rank")


def to_post(df: DataFrame) -> DataFrame:
    """Social posts in the shape of forum posts."""
    return df.select(
        "post_id", "title", "text", "url", F.lit("unknown").alias("channel"), "date",
        F.array().cast("array<string>").alias("comments"),
    )


def item_text(kind: str, **cols: Column) -> Column:
    """Stored display text of an item: ``forum``, ``organic`` or ``social``."""
    if kind == "organic":
        return F.concat(
            F.lit("["), first_present(cols["label"], F.lit("unknown date")), F.lit("] "),
            F.substring(cols["text"], 1, 1200),
            F.lit("\nURL: "), first_present(cols["url"], F.lit("n/a")),
        )
    base = F.concat_ws("\n", cols["title"], F.substring(cols["text"], 1, 700))
    if kind == "social":
        return base
    bullets = F.array_join(F.transform(head(cols["comments"], 4), lambda c: F.concat(F.lit("- "), c)), "\n")
    block = F.concat(base, F.lit("\n\nTop comments:\n"), F.substring(bullets, 1, 900))
    return F.when(F.size(cols["comments"]) > 0, block).otherwise(base)


# --- Entities -------------------------------------------------------------------------------


def select_entities(entities: DataFrame, name: str | None = None) -> DataFrame:
    """All entities, or the one whose name equals ``name`` ignoring case."""
    if name is None:
        return entities
    return entities.filter(F.lower("name") == name.lower())


def entities_with_id(entities: DataFrame, col: str = "network_id") -> DataFrame:
    return entities.filter(F.col(col) != "")


def expand_queries(entities: DataFrame, mode: str) -> DataFrame:
    """Search queries per entity. Keywords are normalised inside the row, so nothing is shuffled."""
    term = first_present(F.col("search_term"), F.col("name"))
    if mode == "commentary":
        chosen = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array(term))
        phrases = head(chosen, V.MAX_COMMENTARY_QUERIES)
    else:
        fixed = V.PRICING_KEYWORDS if mode == "pricing" else V.DISCUSSION_KEYWORDS
        defaults = F.array(*[F.lit(k) for k in fixed])
        given = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(defaults)
        trimmed = F.filter(F.transform(given, strip), lambda k: k != "")
        unique = let(trimmed, distinct_ignoring_case)
        phrases = F.transform(
            head(unique, V.MAX_KEYWORDS), lambda k: F.format_string('"%s" "%s"', term, k)
        )
    return entities.select("entity_id", F.posexplode(phrases).alias("keyword_idx", "query"))
