"""Text columns: whitespace, hashing, sanitising and the truncation rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that text tools call whitespace (Java's \s alone misses NBSP, U+0085
# and U+001C-1F), those that do not end a line, and those that do not end one and are not blank.
WS = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}]"
NOT_WS = r"[^\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}]"
NOT_BREAK = r"[^\n\x0b\f\r\x1c\x1d\x1e\x85\p{Zl}\p{Zp}]"
INLINE_WS = r"[\t\x1f\x20\xa0\p{Zs}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Nested text rules refer to their input several times; without a binding the expression tree
    would double at every level.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACES))


def collapse(col: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col, rf"{WS}+", " "))


def blank_to_null(col: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(col != "", col)


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def stripped_lines(col: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.filter(F.transform(F.regexp_extract_all(col, F.lit(f"({NOT_BREAK}+)"), 1), strip), lambda x: x != "")


def head(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)


def rfind(col: Column, needle: str) -> Column:
    """0-based index of the last one-character ``needle``, -1 when there is none."""
    at = F.instr(F.reverse(col), F.lit(needle))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(col) - at)


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(f"{NOT_WS}+"))


def sha_prefix(col: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(col, 256), 1, n)


def content_hash(col: Column) -> Column:
    """Hash that ignores whitespace differences."""
    return F.sha2(collapse(col), 256)


def sanitize(col: Column) -> Column:
    """Drop control characters other than newline and tab."""
    return F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F]", "")


def truncate(col: Column, n: int, marker: str = " [truncated]") -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(marker))).otherwise(col)


def leading(col: Column, n: int) -> Column:
    """A start of the text that holds its first ``n`` characters other than whitespace; all of it if it has fewer.

    Collapsed, it is the start of the collapsed text, so a long text need not be collapsed whole to be cut.
    """
    return F.regexp_extract(col, rf"^{WS}*+((?:{NOT_WS}{WS}*+){{0,{n}}}+)", 1)


def truncate_words(col: Column, n: int, min_split: int) -> Column:
    """Cut at the last space at or after ``min_split``, trim trailing punctuation, add an ellipsis."""

    def cut(headed: Column) -> Column:
        at = rfind(headed, " ")
        kept = F.when(at >= min_split, F.substring(headed, F.lit(1), at)).otherwise(headed)
        return F.concat(F.regexp_replace(kept, r"[ ,;:.]+$", ""), F.lit("…"))

    return let(
        collapse(leading(col, n + 1)),
        lambda c: F.when(F.length(c) <= n, c).otherwise(let(rstrip(F.substring(c, 1, n)), cut)),
    )


def truncate_phrase(col: Column, n: int = 220) -> Column:
    return truncate_words(col, n, 48)


def truncate_note(col: Column, n: int = 140) -> Column:
    return truncate_words(col, n, 60)


def truncate_smart(col: Column, n: int) -> Column:
    """Prefer a sentence end at or after 60, then a space at or after 40, then a hard cut."""

    def cut(headed: Column) -> Column:
        sentence = F.regexp_extract(headed, r"(?s)^.*[.!?;]", 0)
        space = rfind(headed, " ")
        return (
            F.when(F.length(sentence) > 60, strip(sentence))
            .when(space >= 40, F.concat(rstrip(F.substring(headed, F.lit(1), space)), F.lit("…")))
            .otherwise(F.concat(headed, F.lit("…")))
        )

    return F.when(F.length(col) <= n, col).otherwise(let(rstrip(F.substring(col, 1, n)), cut))


def distinct_ignoring_case(arr: Column) -> Column:
    """Keep the first of equal items (case-insensitive), in order; lists without equal items stay as they are."""
    return let(
        F.transform(arr, lambda x: F.lower(x)),
        lambda low: F.when(F.size(F.array_distinct(low)) == F.size(arr), arr).otherwise(
            F.filter(arr, lambda x, i: F.array_position(low, F.lower(x)) == (i + 1).cast("bigint"))
        ),
    )
