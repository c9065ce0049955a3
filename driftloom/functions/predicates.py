"""Boolean signals over text and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions import vocab as V


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive search; missing text never matches."""
    return F.coalesce(col.rlike(V.RX + pattern), F.lit(False))


def has_price_signal(col: Column) -> Column:
    return matches(col, V.PRICE_SIGNAL)


def has_specific_price(col: Column) -> Column:
    return matches(col, V.CONCRETE_PRICE)


def is_finance(channel: Column) -> Column:
    return matches(channel, V.FINANCE_CHANNEL)


def has_customer_signal(col: Column) -> Column:
    return matches(col, V.CUSTOMER_SIGNAL)


def has_employee_signal(col: Column) -> Column:
    return matches(col, V.EMPLOYEE_SIGNAL)


def is_pricing_callout(col: Column) -> Column:
    return matches(col, V.PRICING_CALLOUT)


def is_non_material(col: Column) -> Column:
    return matches(col, V.NON_MATERIAL_PRICING)


def is_blocked(url: Column) -> Column:
    """The capture ended on a sign-in or verification page."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(m) for m in V.BLOCKED_MARKERS])


def starts_with_any(col: Column, prefixes: list[str]) -> Column:
    return col.rlike("^(?:" + "|".join(prefixes) + ")")


def page_state(col: Column) -> Column:
    """Comma-joined capture-state markers found in the page text."""
    from driftloom.functions.text import collapse, let

    def markers(low: Column) -> Column:
        found = F.array_distinct(
            F.filter(
                F.array(*[F.when(low.contains(n), F.lit(m)) for n, m in V.PAGE_STATE_MARKERS]),
                lambda m: m.isNotNull(),
            )
        )
        return (
            F.when(low == "", F.lit("empty-body"))
            .when(F.size(found) == 0, F.lit("no-known-marker"))
            .otherwise(F.array_join(found, ","))
        )

    return let(F.lower(collapse(F.coalesce(col, F.lit("")))), markers)
