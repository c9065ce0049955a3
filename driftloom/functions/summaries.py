"""Rules over summary text: signal lines, bullets, cards and bullet lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.predicates import is_pricing_callout, starts_with_any
from driftloom.functions.text import (
    INLINE_WS,
    NOT_BREAK,
    NOT_WS,
    collapse,
    head,
    let,
    rstrip,
    strip,
    stripped_lines,
    truncate,
    truncate_phrase,
    truncate_smart,
    word_count,
)

#: Starts of lines that are no points, whatever their case.
COMPACT_SKIP = "^(?i:" + "|".join(V.COMPACT_SKIP_PREFIXES) + ")"
HEADING_OR_SKIP = f"(?U:{V.HEADING_MARK})|{COMPACT_SKIP}"
SYNTHESIS = "(?i:step 3|synthes)"


def drop_bullet_mark(col: Column) -> Column:
    return strip(F.regexp_replace(col, "(?U)" + V.BULLET_MARK, ""))


def is_short_heading(line: Column, words: int = 5) -> Column:
    return line.endswith(":") & (word_count(line) <= words)


def signal_line(col: Column, n: int = 180) -> Column:
    """First useful line without its marks, cut to ``n``; else the whole text, collapsed and cut."""

    def clean(line: Column) -> Column:
        return strip(F.regexp_replace(drop_bullet_mark(line), r"\*+", ""))

    def pick(text: Column) -> Column:
        useful = F.filter(
            F.transform(stripped_lines(text), clean),
            lambda x: ~starts_with_any(F.lower(x), V.SIGNAL_SKIP_PREFIXES) & ~is_short_heading(x),
        )
        return rstrip(F.substring(collapse(F.coalesce(F.get(useful, F.lit(0)), text)), 1, n))

    return let(F.coalesce(col, F.lit("")), pick)


def inline_bullets(col: Column) -> Column:
    """One entry per bullet or line: a line ends where a bullet mark with text after it begins."""
    plain = NOT_BREAK[:-1] + r"•\p{Nd}]"  # what begins no mark; a run of digits is looked behind once
    no_mark = rf"(?:{plain}++|\p{{Nd}}++(?![.)]{INLINE_WS}+{NOT_WS})|•(?!{INLINE_WS}+{NOT_WS}))*+"
    entries = F.regexp_extract_all(col, F.lit(NOT_BREAK + no_mark), F.lit(0))
    return F.filter(F.transform(entries, strip), lambda x: x != "")


def sentences(col: Column) -> Column:
    """The parts of a collapsed text between blanks that follow a full stop, question or exclamation mark."""
    return F.regexp_extract_all(collapse(col), F.lit(r"(?:[^ ]++|(?<![.!?]) )++"), F.lit(0))


def _point(entry: Column) -> Column:
    """An entry without marks or emphasis; empty if it is a heading or boilerplate."""

    def cleaned(p: Column) -> Column:
        return F.when(is_short_heading(p), F.lit("")).otherwise(strip(F.replace(p, F.lit("**"), F.lit(""))))

    return F.when(entry.rlike(HEADING_OR_SKIP), F.lit("")).otherwise(let(drop_bullet_mark(entry), cleaned))


def _shown(point: Column) -> Column:
    """A point as it is shown, empty if nothing of it is."""
    text = F.btrim(collapse(point), F.lit(" •-*"))
    return let(text, lambda t: F.when(t.rlike(COMPACT_SKIP), F.lit("")).otherwise(t))


def _gather(items: Column, found: Column, most: int, rule: Callable[[Column], Column] | None = None) -> Column:
    """``found`` and what the items add: how many points there were, and the different ones, up to ``most``.

    From the moment ``most`` are kept, items are passed by unread.
    """

    def add(acc: Column, point: Column) -> Column:
        def take(shown: Column, low: Column) -> Column:
            known = (shown == "") | F.array_contains(acc["keys"], low)
            return F.struct(
                (acc["seen"] + 1).alias("seen"),
                F.when(known, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(shown))).alias("kept"),
                F.when(known, acc["keys"]).otherwise(F.concat(acc["keys"], F.array(low))).alias("keys"),
            )

        return let(_shown(point), lambda shown: let(F.lower(shown), lambda low: take(shown, low)))

    def step(acc: Column, item: Column) -> Column:
        more = add(acc, item) if rule is None else let(rule(item), lambda p: F.when(p == "", acc).otherwise(add(acc, p)))
        return F.when(F.size(acc["kept"]) >= most, acc).otherwise(more)

    return F.aggregate(items, found, step)


def bullet_points(col: Column, most: int = 3) -> Column:
    """The first ``most`` different points of verbose model output, for bullet lists of any length up to that.

    ``late``: points after the first "step 3" or synthesis line, and ``late_seen``, how many these were before the
    walk ended; ``points``: the late ones, then those of the whole text; if there are none, its sentences.
    """
    nothing = F.struct(
        F.lit(0).alias("seen"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("keys")
    )

    def after_synthesis(entries: Column) -> Column:
        at = F.array_position(F.transform(entries, lambda e: e.rlike(SYNTHESIS)), F.lit(True)).cast("int")
        return F.slice(entries, at + 1, F.size(entries))

    def gather(entries: Column) -> Column:
        late = F.when(F.exists(entries, lambda e: e.rlike(SYNTHESIS)), _gather(after_synthesis(entries), nothing, most, _point)).otherwise(nothing)

        def rest(late: Column) -> Column:
            found = let(
                _gather(entries, late, most, _point),
                lambda a: F.when(a["seen"] == 0, _gather(sentences(col), nothing, most)).otherwise(a),
            )
            return F.struct(late["seen"].alias("late_seen"), late["kept"].alias("late"), found["kept"].alias("points"))

        return let(late, rest)

    return let(inline_bullets(col), gather)


def bullets(points: Column, n: int = 3, chars: int = 220) -> Column:
    """A list of ``n`` bullets from :func:`bullet_points` of as many or more; late points alone if there are ``n`` of them."""
    kept = head(F.when(points["late_seen"] >= n, points["late"]).otherwise(points["points"]), n)
    rows = F.transform(kept, lambda t: F.concat(F.lit("• "), truncate_smart(t, chars)))
    return F.when(F.size(kept) > 0, F.array_join(rows, "\n")).otherwise(F.lit("• Summary unavailable"))


def compact_bullets(col: Column, n: int = 3, chars: int = 220) -> Column:
    """A short bullet list from verbose model output."""
    text = let(bullet_points(col, n), lambda p: bullets(p, n, chars))
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("")).otherwise(text)


def truncate_block(col: Column) -> Column:
    return truncate(col, V.BLOCK_CHARS, "\n_[truncated]_")


def fit_bullets(col: Column, n: int) -> Column:
    """Whole bullets up to ``n`` characters, with a notice when some are left out."""
    budget = max(200, n - len(V.TRUNCATED_NOTICE) - 1)

    def prefix(rows: Column) -> Column:
        start = F.struct(
            F.lit(-1).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open")
        )

        def step(acc: Column, line: Column) -> Column:
            used = acc["used"] + F.length(line) + 1
            take = acc["open"] & (used <= budget)
            return F.struct(
                F.when(take, used).otherwise(acc["used"]).alias("used"),
                F.when(take, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"),
                take.alias("open"),
            )

        kept = F.aggregate(rows, start, step, lambda acc: acc["kept"])

        def render(k: Column) -> Column:
            noted = F.when(F.size(k) < F.size(rows), F.concat(k, F.array(F.lit(V.TRUNCATED_NOTICE)))).otherwise(k)
            return F.when(F.size(k) == 0, truncate_block(col)).otherwise(F.array_join(noted, "\n"))

        bullets_only = (F.size(rows) > 0) & F.forall(rows, lambda x: x.startswith("•"))
        return F.when(bullets_only, let(kept, render)).otherwise(truncate_block(col))

    return F.when(F.length(col) <= n, col).otherwise(let(stripped_lines(col), prefix))


def normalize_card(raw: Column, name: Column) -> Column:
    """A signal card in its fixed shape: name, then at most five bullets."""

    def clean(line: Column) -> Column:
        low = F.lower(line)
        dropped = (
            low.startswith("competitor:") | low.startswith("signals:") | is_short_heading(line, 4)
        )
        return F.when(dropped, F.lit("")).otherwise(drop_bullet_mark(line))

    points = head(F.filter(F.transform(stripped_lines(raw), clean), lambda x: x != ""), 5)
    bullets = F.transform(points, lambda p: F.concat(F.lit("- "), truncate_phrase(p)))
    return card(name, bullets)


def card(name: Column, bullets: Column) -> Column:
    body = let(
        bullets,
        lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n")).otherwise(F.lit(V.NO_MOVEMENT)),
    )
    return F.concat(F.lit("Competitor: "), name, F.lit("\nSignals:\n"), body)


def ensure_pricing(col: Column, pricing_bullet: Column, n: int) -> Column:
    """Prepend the pricing bullet unless some line already is a pricing callout; first ``n`` lines."""

    def merged(rows: Column) -> Column:
        has = F.exists(rows, is_pricing_callout)
        out = F.when(has | pricing_bullet.isNull(), rows).otherwise(F.concat(F.array(pricing_bullet), rows))
        return F.when(F.size(rows) == 0, col).otherwise(F.array_join(head(out, n), "\n"))

    return let(stripped_lines(col), merged)


def append_bullet(col: Column, bullet: Column, n: int) -> Column:
    """Add a line and keep the last ``n``; a null bullet changes nothing."""
    rows = F.concat(stripped_lines(F.coalesce(col, F.lit(""))), F.array(strip(bullet)))
    text = let(
        rows,
        lambda r: F.array_join(
            F.when(F.size(r) > n, F.slice(r, F.size(r) - n + 1, F.lit(n))).otherwise(r), "\n"
        ),
    )
    return F.when(bullet.isNull(), col).otherwise(text)
