"""Fields of ad cards and organic-post cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.ids import item_id, text_id
from driftloom.functions.predicates import matches
from driftloom.functions.recency import posted_label
from driftloom.functions.text import blank_to_null, collapse, head, strip, stripped_lines
from driftloom.operators.posts import top_n


def parse_ad_cards(cards: DataFrame, n: int = V.MAX_CARDS) -> DataFrame:
    """Ad text, impressions, run dates and format of each entity's first ``n`` cards."""
    shown = top_n(cards, ["entity_id"], ["pos"], n).drop("_rank")
    usable = shown.filter(F.length(strip(F.col("card_text"))) >= 10)
    lined = usable.withColumns(
        {"_lines": stripped_lines(F.col("card_text")), "_low": F.lower("card_text")}
    )
    fmt = F.coalesce(
        *[F.when(F.col("_low").contains(needle), F.lit(name)) for needle, name in V.AD_FORMATS],
        F.lit("Unknown"),
    )

    def first_line(pattern: str):
        return F.get(F.filter("_lines", lambda x: matches(x, pattern)), F.lit(0))

    parsed = lined.withColumns(
        {
            "ad_text": F.array_join(head(F.col("_lines"), 15), " "),
            "ad_format": fmt,
            "impressions_range": first_line(V.IMPRESSIONS_LINE),
            "date_range": first_line(V.RUN_DATE_LINE),
        }
    )
    return parsed.withColumn("ad_id", text_id(F.col("ad_text"))).drop("_lines", "_low")


def parse_organic_cards(cards: DataFrame) -> DataFrame:
    """Body, age label and id of each organic card.

    Cards have ``bodies`` (candidate texts), ``label_texts`` (candidate labels), ``full_text`` and
    ``url``. Cards without a usable body are dropped.
    """
    bodies = F.filter(F.transform("bodies", collapse), lambda b: F.length(b) > 20)
    whole = collapse(F.col("full_text"))
    body = F.coalesce(
        F.get(bodies, F.lit(0)), F.when(F.length(whole) >= 40, F.substring(whole, 1, 1200))
    )
    with_body = cards.withColumn("_body", body).filter(F.col("_body").isNotNull())
    parsed = with_body.withColumn("posted_label", posted_label(F.col("label_texts"), F.col("full_text")))
    return parsed.withColumns(
        {
            "post_id": item_id(blank_to_null(F.col("url")), F.col("_body"), F.col("posted_label")),
            "post_text": strip(F.substring("_body", 1, 1800)),
        }
    ).drop("_body")
