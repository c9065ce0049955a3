"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings. SQL functions only.

Spans are in code points, the end exclusive. A null or empty text has no spans; very long texts and
candidates are scanned whole; repeated rows are scanned each for itself, so their results are equal.
Only the id and the text are read: other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import let, scan

# The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What remains of a match without its value, to tell the value's length.
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ASSIGN_LEAST = 6
#: A run's leftmost match takes the whole run, so the length can be part of these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

#: Class -> its characters, the window's length, and the least bits a character in a window that counts.
ENTROPY_CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 24, 3.1),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 32, 4.1),
}
#: Whole candidates that are known to be harmless: words, names and paths of words, numbers, universal identifiers.
#: None of these patterns repeats a group, which a regular expression follows by recursion.
ALLOWED_WHOLE = (
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
#: Parts that are known: counting and alphabet runs, documented examples. They silence the windows that overlap them, no others.
ALLOWED_PARTS = r"(?i)0123456789abcdef|abcdefghijklmnop|1234567890123456|example"
#: Bits are added up as whole millionths, so that what a character adds is taken away exactly.
SCALE = 1_000_000


def class_pattern(characters: str, window: int) -> str:
    return f"[{characters.replace('-', '')}{'-' if '-' in characters else ''}]{{{window},}}"


def bits(count: int) -> int:
    """``count * log2(count)`` in millionths; the entropy of a window is log2(n) minus their sum by n."""
    return round(count * math.log2(count) * SCALE) if count else 0


def most_bits(window: int, least: float) -> int:
    """The largest sum of ``bits`` of a window whose entropy is at least ``least``."""
    return math.floor(window * (math.log2(window) - least) * SCALE)


def matches(text: Column, found: Column, pattern: str) -> Column:
    """Matches with their places: (start, end, match), from the matches and what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(gaps, F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), F.coalesce(m, F.lit(0)).alias("m")))
    placed = let(
        both,
        lambda b: F.zip_with(
            scan(F.transform(b, lambda x: x["g"] + x["m"]), F.lit(0), lambda a, v: a + v),
            b,
            lambda before, x: before + x["g"],
        ),
    )
    spans = F.zip_with(
        F.slice(placed, 1, F.size(found)),
        found,
        lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")),
    )
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    return F.when(F.size(found) > 0, spans).otherwise(nothing)


def dense_parts(candidate: Column, characters: str, window: int, least: float, silent: Column) -> Column:
    """Parts (start, end) of a candidate whose windows reach the entropy; overlapping windows are one part.

    Windows that overlap one of the ``silent`` places do not count. One character enters and one leaves at each step: two counts change, and the sum of bits with them.
    """
    table = F.array(*[F.lit(bits(c)).cast("bigint") for c in range(window + 2)])
    limit = F.lit(most_bits(window, least)).cast("bigint")

    def step(s: Column, p: Column, codes: Column, cost: Column, quiet: Column) -> Column:
        came = F.element_at(codes, p)
        left = F.when(p > window, F.element_at(codes, F.greatest(p - window, F.lit(1)))).otherwise(0)
        n_came = F.element_at(s["counts"], came)
        n_left = F.when(left > 0, F.element_at(s["counts"], F.greatest(left, F.lit(1)))).otherwise(0)
        delta = (
            F.element_at(cost, n_came + 2) - F.element_at(cost, n_came + 1)
            + F.when(left > 0, F.element_at(cost, F.greatest(n_left, F.lit(1))) - F.element_at(cost, n_left + 1)).otherwise(0)
        )
        total = s["total"] + F.when(came == left, F.lit(0)).otherwise(delta)
        counts = F.transform(
            s["counts"], lambda c, i: c + F.when(i + 1 == came, 1).otherwise(0) - F.when(i + 1 == left, 1).otherwise(0)
        )
        start = p - window
        hit = (p >= window) & (total <= limit) & ~F.exists(quiet, lambda q: (q["start"] < p) & (q["end"] > start))
        joins = hit & (s["to"] > start)
        done = F.when(
            hit & ~joins & (s["to"] > 0),
            F.concat(s["parts"], F.array(F.struct(s["from"].alias("start"), s["to"].alias("end")))),
        ).otherwise(s["parts"])
        return F.struct(
            counts.alias("counts"), total.alias("total"), F.when(hit & ~joins, start).otherwise(s["from"]).alias("from"),
            F.when(hit, p).otherwise(s["to"]).alias("to"), done.alias("parts"),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0), len(characters)).alias("counts"), F.lit(0).cast("bigint").alias("total"),
        F.lit(0).alias("from"), F.lit(0).alias("to"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("parts"),
    )
    last = lambda s: F.when(
        s["to"] > 0, F.concat(s["parts"], F.array(F.struct(s["from"].alias("start"), s["to"].alias("end"))))
    ).otherwise(s["parts"])
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(characters), c))
    return let(
        codes,
        lambda cs: let(
            table,
            lambda cost: let(
                silent,
                lambda quiet: F.aggregate(F.sequence(F.lit(1), F.size(cs)), zero, lambda s, p: step(s, p, cs, cost, quiet), last),
            ),
        ),
    )


def allowed(candidate: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | candidate.rlike(pattern)
    return found


def silenced(candidate: Column, pattern: str) -> Column:
    """Places (start, end) of the known parts of a candidate."""
    places = matches(candidate, F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0)), pattern)
    return F.transform(places, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def secret_spans(
    docs: DataFrame,
    text: str = "text",
    classes: dict[str, tuple[str, int, float]] | None = None,
    allowed_whole: tuple[str, ...] = ALLOWED_WHOLE,
    allowed_parts: str = ALLOWED_PARTS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of ``keep`` (default: all), and ``secrets``: (start, rank, end, kind) in order of start, then kind.

    Base kinds are always reported; what is allowed only silences what entropy alone has found.
    The new column replaces one of its name.
    """
    classes = ENTROPY_CLASSES if classes is None else classes
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != "secrets"]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    patterns |= {name: class_pattern(chars, window) for name, (chars, window, _) in classes.items()}
    found = docs.select(
        F.struct(*kept).alias("__row"),
        whole.alias("__text"),
        *[F.regexp_extract_all(whole, F.lit(p), F.lit(0)).alias(f"__{k}") for k, p in patterns.items()],
    )

    def tagged(kind: str, rank: int) -> Column:
        tag = lambda start, end: F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")
        )
        strings = F.col(f"__{kind}")
        places = matches(F.col("__text"), strings, patterns[kind])
        if kind == "assign":
            long_enough = lambda m: F.length(F.regexp_replace(m["match"], ASSIGN_HEAD, "")) >= ASSIGN_LEAST
            places = F.filter(places, long_enough)
        if kind in classes:
            chars, window, least = classes[kind]
            suspects = F.filter(places, lambda m: ~allowed(m["match"], allowed_whole))
            hits = F.flatten(
                F.transform(
                    suspects,
                    lambda m: F.transform(
                        dense_parts(m["match"], chars, window, least, silenced(m["match"], allowed_parts)), lambda part: tag(m["start"] + part["start"], m["start"] + part["end"])
                    ),
                )
            )
        else:
            hits = F.transform(places, lambda m: tag(m["start"], m["end"]))
        nothing = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
        return F.when(F.size(strings) > 0, hits).otherwise(nothing)

    spans = F.array_sort(F.concat(*[tagged(k, i) for i, k in enumerate(patterns)]))
    return found.select("__row", spans.alias("secrets")).select("__row.*", "secrets")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; touching and overlapping spans share one mark."""
    ends = F.transform(spans, lambda s: s["end"])
    reached = scan(ends, F.lit(0), lambda a, e: F.greatest(a, e))
    parts = F.zip_with(
        spans, reached, lambda s, r: F.struct(s["start"].alias("start"), F.greatest(s["end"], r).alias("end"), r.alias("before"))
    )
    body = F.transform(
        parts,
        lambda p: F.when(p["start"] < p["before"], F.lit("")).otherwise(
            F.concat(
                F.substring(text, p["before"] + 1, p["start"] - p["before"]),
                F.when((p["start"] > p["before"]) | (p["before"] == 0), F.lit(mark)).otherwise(F.lit("")),
            )
        ),
    )
    tail = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(body, ""), tail)).otherwise(text)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")
