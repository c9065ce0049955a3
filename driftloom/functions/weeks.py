"""Calendar labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_label(ts: Column) -> Column:
    """``%Y-W%W``: Monday weeks 00-53 that restart on 1 January (not ISO weeks)."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def epoch_date(seconds: Column) -> Column:
    """UTC date text of epoch seconds, whatever the session time zone."""
    days = F.floor(seconds / 86400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
