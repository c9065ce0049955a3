"""Age labels: finding them and deciding whether they are recent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.predicates import matches
from driftloom.functions.text import blank_to_null, collapse, let, strip


def looks_like_age(col: Column) -> Column:
    low = F.lower(col)
    named = low.contains("yesterday") | low.contains("today") | low.contains("just now")
    return named | matches(col, V.AGE_TOKEN) | matches(col, V.DATE_TOKEN)


def age_token(text: Column) -> Column:
    """First age or date token inside free text, null when there is none."""
    low = F.lower(text)
    named = [F.when(low.contains(k), F.lit(k)) for k in ("just now", "today", "yesterday")]
    return F.coalesce(
        *named,
        blank_to_null(F.regexp_extract(low, V.RX + "(" + V.AGE_TOKEN + ")", 1)),
        blank_to_null(F.regexp_extract(text, V.RX + "(" + V.DATE_TOKEN + ")", 1)),
    )


def posted_label(raws: Column, full_text: Column) -> Column:
    """First bullet-separated part of the candidate texts that reads as an age, else a token."""
    parts = F.flatten(F.transform(raws, lambda r: F.split(collapse(r), "•")))
    ages = F.filter(F.transform(parts, strip), lambda p: (p != "") & looks_like_age(p))
    return F.coalesce(F.get(ages, F.lit(0)), age_token(collapse(full_text)))


def _age_days(text: Column) -> Column:
    """Days encoded in a relative label such as ``3d`` or ``2 weeks``; null when it has none."""
    value = F.regexp_extract(text, V.RX + V.AGE_PARTS, 1).try_cast("double")
    unit = F.regexp_extract(text, V.RX + V.AGE_PARTS, 2)
    per_unit = (
        F.when(unit.isin("m", "min", "minute", "minutes", "h", "hr", "hour", "hours"), F.lit(0.0))
        .when(unit.isin("d", "day", "days"), F.lit(1.0))
        .when(unit.isin("w", "wk", "week", "weeks"), F.lit(7.0))
        .when(unit.isin("mo", "month", "months"), F.lit(30.0))
        .when(unit != "", F.lit(365.0))
    )
    return value * per_unit


def _label_date(text: Column, as_of: Column) -> Column:
    """Calendar date of an absolute label; a year-less date that lies ahead belongs to last year."""
    words = "|".join(V.MONTHS + [m[:3] for m in V.MONTHS if len(m) > 3])
    pattern = V.RX + rf"^({words})\s+(\d{{1,2}})(?:,\s+(\d{{4}}))?$"
    month = F.array_position(
        F.array(*[F.lit(m[:3]) for m in V.MONTHS]),
        F.substring(F.lower(F.regexp_extract(text, pattern, 1)), 1, 3),
    )
    day, year = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)

    def on(y: Column) -> Column:
        stamp = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), month.cast("string"), day)
        return F.try_to_timestamp(stamp, F.lit("yyyy-M-d")).cast("date")

    today = F.to_date(as_of)
    this_year = on(F.year(today))
    rolled = F.when(this_year > today, on(F.year(today) - 1)).otherwise(this_year)
    bare_ok = on(F.lit(1900)).isNotNull()  # a bare "Feb 29" is not a readable date
    return F.when(month == 0, F.lit(None)).when(year != "", on(year)).when(bare_ok, rolled)


def within_days(label: Column, n: int, as_of: Column) -> Column:
    """Whether a posted-label is at most ``n`` days old; unreadable labels count as recent."""

    def decide(text: Column) -> Column:
        low = F.lower(text)
        return (
            F.when(low == "", F.lit(True))
            .when(low.contains("just now") | low.contains("today"), F.lit(True))
            .when(low.contains("yesterday"), F.lit(n >= 1))
            .otherwise(
                F.coalesce(
                    _age_days(low) <= n,
                    F.datediff(F.to_date(as_of), _label_date(text, as_of)) <= n,
                    F.lit(True),
                )
            )
        )

    return F.coalesce(let(strip(label), decide), F.lit(True))
