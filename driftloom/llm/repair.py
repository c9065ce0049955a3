"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``, by bidirectional Dijkstra.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3, a must for blank and duplicate rows) and Insert an
empty user or assistant message anywhere (2); a truncated row that is not deleted adds 1. A node of the lattice is the
number of rows done and what the last message was. Heaps from both ends meet; all crossings of least cost are
finished, and the one with the least concatenated audit counts. At one node two audits of equal cost are never each
other's beginning (more letters on the same rows are inserts, which cost), so the least audit has least parts.

A conversation's rows stand in the order of turn, role, text (nulls first). Rows alike in all of these are one row with a
number of copies. Rows are dealt by ranges of that order, so a conversation of any length is cut into pieces; each
piece is a small table of cheapest edits from entry to exit, and the tables of a conversation are chained. The messages
come in chunks, one for each piece.

Null texts are blank; a null or unknown role can only be changed or deleted; null turns come first and count in no gap;
rows without conv_id are one conversation. A conversation whose rows are all gone (or an empty one) has zeros
and no message. Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import written

#: Rows and characters of a piece, and of a range on the average.
PIECE_ROWS, PIECE_CHARS = 512, 4 << 20
RANGE_ROWS, RANGE_CHARS = 20_000, 16 << 20
BLANKS = " \t\n\x0b\x0c\r"

#: Last message: none, system, user, assistant.
NONE, S, U, A = range(4)
STATES = (NONE, S, U, A)
KEEPS = {NONE: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: What an inserted or changed message must be.
NEXT = {NONE: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
CHANGE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


def cheapest(rows: list[tuple], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) from ``start`` before the rows to one of ``goals`` after them. Rows are (initial, fault, copies).

    Copies after the first are deleted in any case, right behind it, where their letters are least.
    """
    n = len(rows)

    def through(i: int, q: int, to: int | None = None) -> Iterator[tuple[int, int, str]]:
        """(next state, cost, letters) of row ``i``; with ``to``, (state before, ...) of what ends in ``to``."""
        initial, fault, copies = rows[i]
        more = copies - 1
        yield (q if to is None else to), DELETE * copies, "D" * copies
        if fault not in ("blank", "duplicate"):
            extra = DELETE * more + (TRUNCATED if fault == "truncated" else 0)
            for before in (q,) if to is None else STATES:
                kept = KEEPS[before].get(initial)
                if kept is not None and to in (None, kept):
                    yield (kept if to is None else before), extra, "K" + "D" * more
                if to in (None, NEXT[before]):
                    yield (NEXT[before] if to is None else before), extra + CHANGE, "R" + "D" * more

    def on(i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
        yield i, NEXT[q], INSERT, "I"
        if i < n:
            for to, cost, letters in through(i, q):
                yield i + 1, to, cost, letters

    def back(i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
        for before in STATES:
            if NEXT[before] == q:
                yield i, before, INSERT, "I"
        if i:
            for before, cost, letters in through(i - 1, q, q):
                yield i - 1, before, cost, letters

    found: list[dict] = [{(0, start): (0, "")}, {(n, goal): (0, "") for goal in goals}]
    heaps = [[(0, 0, start)], [(0, -n, goal) for goal in goals]]
    heapq.heapify(heaps[1])
    done: list[set] = [set(), set()]
    best: tuple[int, str] | None = None

    while heaps[0] or heaps[1]:
        tops = [heap[0][0] if heap else 0 for heap in heaps]
        if best is not None and sum(tops) > best[0]:
            break
        side = 0 if heaps[0] and (not heaps[1] or tops[0] <= tops[1]) else 1
        cost, place, q = heapq.heappop(heaps[side])
        node = (abs(place), q)
        if node in done[side]:
            continue
        done[side].add(node)
        cost, audit = found[side][node]
        if node in done[1 - side]:
            far = found[1 - side][node]
            whole = (cost + far[0], audit + far[1] if side == 0 else far[1] + audit)
            best = whole if best is None else min(best, whole)
        for i, q, step, letters in (back if side else on)(*node):
            other = (i, q)
            reached = (cost + step, letters + audit if side else audit + letters)
            if other in done[1 - side]:
                far = found[1 - side][other]
                total = reached[0] + far[0]
                if best is None or total <= best[0]:
                    whole = (total, far[1] + reached[1] if side else reached[1] + far[1])
                    best = whole if best is None else min(best, whole)
            if other not in done[side] and (other not in found[side] or reached < found[side][other]):
                if other not in found[side] or reached[0] < found[side][other][0]:
                    heapq.heappush(heaps[side], (reached[0], -i if side else i, q))
                found[side][other] = reached
    return best


def messages_of(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The repaired messages (edit, role, text) of a piece that is entered in ``state``."""
    out, i, copy = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append({"edit": "I", "role": ROLE[state], "text": ""})
            continue
        row = rows[i]
        if letter == "K":
            state = KEEPS[state][row["role"][:1]]
            out.append({"edit": "K", "role": row["role"], "text": row["text"]})
        elif letter == "R":
            state = NEXT[state]
            out.append({"edit": "R", "role": ROLE[state], "text": row["text"]})
        copy += 1
        if copy == row["copies"]:
            i, copy = i + 1, 0
    return out


def _initial(row: dict) -> str:
    return (row["role"] or "")[:1]


def _facts(rows: list[dict]) -> dict:
    """What is counted of a piece's rows, and what its neighbours must know."""
    faults = {kind: sum(1 for r in rows if r["fault"] == kind) for kind in ("blank", "duplicate", "truncated")}
    for r in rows:
        faults["blank" if r["fault"] == "blank" else "duplicate"] += r["copies"] - 1
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [_initial(r) for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(r["copies"] - 1 for r in rows)
    return faults | {
        "illegal": illegal, "n_turns": sum(a != b for a, b in zip([None, *turns], turns, strict=False)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
    }


_FACTS = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, first_turn bigint, last_turn bigint, first string, last string"
)
_MESSAGES = "array<struct<edit:string,role:string,text:string>>"
_ROWS = "array<struct<role:string,text:string,copies:bigint>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _gaps(first: int | None, last: int | None, n_turns: int) -> int:
    return 0 if first is None else last - first + 1 - n_turns


def _pieces(ordered: DataFrame, conv_type: str, piece_rows: int, piece_chars: int) -> DataFrame:
    """A written table of pieces. One that is a whole conversation for certain is solved; others have their table of edits."""
    made = (
        f"conv {conv_type}, part bigint, piece bigint, whole boolean, {_FACTS}, gaps bigint, cost bigint, audit string, "
        f"messages {_MESSAGES}, costs array<bigint>, audits array<string>, rows {_ROWS}"
    )

    def each(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        out: list[dict] = []
        conv, piece, first, begun, made_here = None, 0, True, False, 0
        held: list[dict] = []
        chars = 0

        def end(more: bool, last: bool) -> None:
            """The rows held are a piece; the conversation goes on if ``more``, and may do so elsewhere if ``last``."""
            nonlocal made_here
            whole = not (first or more or last or piece)
            made_here += 1
            facts = _facts(held)
            line = [(_initial(r), r["fault"], r["copies"]) for r in held]
            row = {"conv": conv, "part": number, "piece": made_here, "whole": whole} | facts
            if whole:
                cost, audit = cheapest(line, NONE, (NONE, A))
                gaps = _gaps(facts["first_turn"], facts["last_turn"], facts["n_turns"])
                row |= {"gaps": gaps, "cost": cost, "audit": audit, "messages": messages_of(held, audit, NONE)}
            else:
                table = [cheapest(line, a, (b,)) for a in STATES for b in STATES]
                row |= {"costs": [t and t[0] for t in table], "audits": [t and t[1] for t in table]}
                row["rows"] = [{k: r[k] for k in ("role", "text", "copies")} for r in held]
            out.append(row)

        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv"] != conv:
                    end(False, False)
                    held, chars, piece, first = [], 0, 0, False
                elif len(held) >= piece_rows or chars >= piece_chars:
                    end(True, False)
                    held, chars, piece = [], 0, piece + 1
                conv, begun = row["conv"], True
                if not row["gone"]:
                    held.append(row)
                    chars += len(row["text"] or "")
                if len(out) >= 2048 or sum(len(r.get("rows") or ()) for r in out[-8:]) > piece_rows:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if begun:
            end(False, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    text = pa.string()
    message = pa.list_(pa.struct([("edit", text), ("role", text), ("text", text)]))
    kept = pa.list_(pa.struct([("role", text), ("text", text), ("copies", pa.int64())]))
    kinds = {"string": text, "bigint": pa.int64(), "boolean": pa.bool_(), _MESSAGES: message, _ROWS: kept,
             "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(text)}
    fields = [c.split(" ", 1) for c in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            types = {name: kinds.get(kind) for name, kind in fields} | {"conv": first.schema.field("conv").type}

            def again() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            yield from each(again(), pa.schema(list(types.items())))

    return written(ordered.mapInArrow(run, made), "conversation-pieces")


def _chain(key: tuple, pieces: pa.Table) -> pa.Table:
    """The pieces of one conversation: the edits of each, its place, and on the first what holds for all."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    suffix: dict[int, tuple[int, str]] = {NONE: (0, ""), A: (0, "")}
    choice: list[dict[int, int]] = []
    for row in reversed(rows):
        before, chosen = {}, {}
        for a in STATES:
            ways = [(row["costs"][4 * a + b] + suffix[b][0], b) for b in STATES if b in suffix and row["costs"][4 * a + b] is not None]
            if ways:
                least = min(ways)[0]
                audit, chosen[a] = min((row["audits"][4 * a + b] + suffix[b][1], b) for cost, b in ways if cost == least)
                before[a] = (least, audit)
        suffix = before
        choice.append(chosen)
    choice.reverse()
    counts = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
    full = [r for r in rows if r["first"] is not None]
    counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:], strict=False))
    timed = [r for r in rows if r["first_turn"] is not None]
    counts["n_turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
    gaps = _gaps(timed[0]["first_turn"], timed[-1]["last_turn"], counts["n_turns"]) if timed else 0
    total = {"gaps": gaps, "cost": suffix[NONE][0], "audit": suffix[NONE][1]} | {c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}
    out, state = [], NONE
    for i, row in enumerate(rows):
        to = choice[i][state]
        place = {"part": row["part"], "piece": row["piece"], "chunk": i, "n_chunks": len(rows), "state": state}
        out.append(place | {"edits": row["audits"][4 * state + to]} | (total if i == 0 else dict.fromkeys(total)))
        state = to
    return pa.Table.from_pylist(out, schema=pa.schema([
        *[(c, pa.int64()) for c in ("part", "piece", "chunk", "n_chunks", "state")], ("edits", pa.string()),
        *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
    ]))


def repair_conversations(
    rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS, range_rows: int = RANGE_ROWS, range_chars: int = RANGE_CHARS
) -> DataFrame:
    """Repaired conversations in chunks: conv_id, chunk (from 0), n_chunks, messages (edit, role, text), and counts and audit.

    ``rows`` has conv_id, turn, role, text; optionally ``copies`` (of the row, in its place) and ``gone`` (the row only
    says that there is such a conversation). The counts, cost and audit stand on the first chunk of a conversation.
    """
    copies = F.col("copies").cast("bigint") if "copies" in rows.columns else F.lit(1).cast("bigint")
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    here = lambda c: F.when(~gone, F.col(c))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    named = rows.select(
        F.col("conv_id").alias("conv"), here("turn").cast("bigint").alias("turn"), here("role").alias("role"), here("text").alias("text"),
        gone.alias("gone"), copies.alias("copies"),
    )
    alike = written(named.groupBy("conv", "turn", "role", "text", "gone").agg(F.sum("copies").alias("copies")), "conversation-rows")

    end = F.rtrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    alike = alike.withColumn("last", F.right(end, F.lit(1))).withColumn("print", F.when(F.col("last") != "", F.sha2("text", 256)))
    # A text that a conversation has in several turns from one role is a duplicate in all but the first.
    again = alike.filter((F.col("last") != "") & ~F.col("gone")).groupBy("conv", "role", "print").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_once")
    ).filter("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("print").alias("p"), "first", "at_once")
    met = alike.join(again, F.col("conv").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r")) & (F.col("print") == F.col("p")), "left")
    repeated = F.coalesce(F.col("turn").isNotNull() & (F.col("at_once") | (F.col("turn") > F.col("first"))), F.lit(False))
    fault = F.when(F.col("last") == "", "blank").when(repeated, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    judged = met.select("conv", "turn", "role", "text", "gone", "copies", fault.alias("fault"))

    n, chars = alike.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // range_rows), -(-(chars or 0) // range_chars))
    ranged = judged.repartitionByRange(parts, "conv", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64))
    pieces = _pieces(ranged.sortWithinPartitions("conv", "turn", "role", "text"), conv_type, piece_rows, piece_chars)

    summary = [*COUNTS, "audit"]
    whole = pieces.filter("whole").select(
        F.col("conv").alias("conv_id"), F.lit(0).cast("bigint").alias("chunk"), F.lit(1).cast("bigint").alias("n_chunks"), "messages", *summary
    )
    cut = pieces.filter("not whole")
    solved = cut.drop("messages", "rows", "whole", "gaps", "cost", "audit").groupBy("conv").applyInArrow(
        _chain, "part bigint, piece bigint, chunk bigint, n_chunks bigint, state bigint, edits string, "
        + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string",
    )
    both = cut.select("conv", "part", "piece", "rows").join(solved, ["part", "piece"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                messages_of(r, edits, state)
                for r, edits, state in zip(*(batch.column(c).to_pylist() for c in ("rows", "edits", "state")), strict=True)
            ]
            kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
            keep = ["conv", "chunk", "n_chunks", *summary]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(made, kind)], [*keep, "messages"])

    told = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"
    rest = both.mapInArrow(apply, f"conv {conv_type}, chunk bigint, n_chunks bigint, {told}, messages {_MESSAGES}")
    return whole.unionByName(rest.withColumnRenamed("conv", "conv_id"))


def lines_of(messages: str = "messages") -> F.Column:
    """``role:text`` of each message, a line each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def digests(chunks: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines of each conversation; one of several chunks is read chunk by chunk, in order."""
    lines = F.when(F.size("messages") > 0, lines_of())
    one = chunks.filter("n_chunks = 1").select("conv_id", F.sha2(F.coalesce(lines, F.lit("")), 256).alias("sha256"))
    conv_type = chunks.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        state, first = None, True
        for batch in batches:
            done = []
            for i, (chunk, n, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_chunks", "lines")), strict=True)):
                if chunk == 0:
                    state, first = hashlib.sha256(), True
                if lines is not None:
                    state.update((b"" if first else b"\n") + lines.encode())
                    first = False
                if chunk == n - 1:
                    done.append((i, state.hexdigest()))
            convs = batch.column("conv_id").take(pa.array([i for i, _ in done], pa.int64()))
            yield pa.RecordBatch.from_arrays([convs, pa.array([d for _, d in done], pa.string())], ["conv_id", "sha256"])

    many = chunks.filter("n_chunks > 1").select("conv_id", "chunk", "n_chunks", lines.alias("lines"))
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(each, f"conv_id {conv_type}, sha256 string")
    return one.unionByName(many)


def damaged(rows: DataFrame) -> DataFrame:
    """Every twentieth of the rows dropped, emptied, without sentence ends, repeated, and made the user's, by a checksum."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
