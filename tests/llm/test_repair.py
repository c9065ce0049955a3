"""Conversation repair against a plain walk over all states."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from driftloom.llm.repair import COUNTS, KEEPS, LEGAL, NEXT, ROLE, STATES, cheapest, damaged, digests, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def forward(rows, start, goals):
    """Least (cost, audit), row by row; each copy is a row."""

    def inserts(states):
        for _ in range(3):
            for q, (cost, audit) in list(states.items()):
                states[NEXT[q]] = min(states.get(NEXT[q], (1 << 30, "")), (cost + 2, audit + "I"))
        return states

    states = inserts({start: (0, "")})
    for initial, fault, copies in rows:
        for copy in range(copies):
            kind, new = fault if copy == 0 or fault == "blank" else "duplicate", {}
            for q, (cost, audit) in states.items():
                ways = [(q, cost + 3, audit + "D")]
                if kind not in ("blank", "duplicate"):
                    late = kind == "truncated"
                    ways.append((NEXT[q], cost + 2 + late, audit + "R"))
                    if initial in KEEPS[q]:
                        ways.append((KEEPS[q][initial], cost + late, audit + "K"))
                for to, *key in ways:
                    new[to] = min(new.get(to, (1 << 30, "")), tuple(key))
            states = inserts(new)
    found = [states[g] for g in goals if g in states]
    return min(found) if found else None


def test_meeting_heaps_find_the_least_audit():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [
            (rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice(["", "", "blank", "duplicate", "truncated"]), rng.choice([1, 1, 1, 2, 3]))
            for _ in range(rng.randrange(8))
        ]
        start, goals = rng.choice(STATES), rng.choice([(0, 3), (0,), (1,), (2,), (3,)])
        assert cheapest(rows, start, goals) == forward(rows, start, goals)


def brute(rows):
    """What the query returns, from all (conv_id, turn, role, text) with copies expanded and dropped rows left out."""
    out = {}
    for conv, lines in rows.items():
        lines = sorted(lines, key=lambda r: tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in r))
        seen, line, faults = set(), [], defaultdict(int)
        for _, role, text in lines:
            rest = (text or "").rstrip(BLANKS)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            line.append(((role or "")[:1], fault, 1))
        turns = [t for t, _, _ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(line, line[1:], strict=False))
        cost, audit = forward(line, 0, (0, 3))
        state, said, rest = 0, [], iter(lines)
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            state = KEEPS[state][row[1][:1]] if letter == "K" else NEXT[state]
            said.append(f"{row[1] if letter == 'K' else ROLE[state]}:{row[2] if row else ''}")
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def answer(chunks):
    digest = {r["conv_id"]: r["sha256"] for r in digests(chunks).collect()}
    rows = chunks.filter("chunk = 0").select("conv_id", *COUNTS, "audit").collect()
    assert len(rows) == len({r["conv_id"] for r in rows}) == len(digest)
    return {r["conv_id"]: (*r[1:], digest[r["conv_id"]]) for r in rows}


def random_rows(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and", "", " \n", None, "Ünd.  \n", "x: y", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    rows = []
    for conv in [None, *range(-3, 25)]:
        for turn in range(rng.randrange(9)):
            at = rng.choice([turn, turn, turn, None, 3, turn * 2])
            rows += [(conv, at, rng.choice(roles), rng.choice([*texts, f"{turn}{'.' * rng.randrange(2)}"]))] * rng.choice([1, 1, 1, 2, 5])
    # One conversation has most of the rows, many of them alike.
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"line {t // 7}" + rng.choice([".", ""])) for t in range(400)]
    rows += [(77, None, "user", "Again and again.")] * 300
    return rows


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 3, "range_rows": 40}, {"piece_rows": 64, "piece_chars": 50, "range_chars": 200}])
def test_against_all_states(spark, sizes):
    rows = random_rows(5)
    grouped = defaultdict(list)
    for conv, *rest in rows:
        grouped[conv].append(tuple(rest))
    got = answer(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5), **sizes))
    assert got == brute(grouped)


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"Well, {c}. And {t}!") for c in range(60) for t in range(7)]
    rows += [(None, None, "user", "Nobody."), (1, None, None, None)]
    kept = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 2 and text is not None:
            text = "".join(ch for ch in text if ch not in ".!?")
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else text)
        kept[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    got = answer(repair_conversations(damaged(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(kept) and {g[6] for g in got.values()} >= {"KKKKKKK"}


def test_gone_and_empty_tables_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi.", 4, "x"), (1, 1, "assistant", "Ho.", 5, None), (2, 0, "user", "Gone.", 6, "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", n int, part string").selectExpr("*", "conv_id = 2 as gone", "1 as copies")
    none = hashlib.sha256(b"").hexdigest()
    assert answer(repair_conversations(df))[2] == (0, 0, 0, 0, 0, 0, "", none)
    assert answer(repair_conversations(df))[1][5:7] == (0, "KK")
    assert repair_conversations(df.limit(0)).count() == 0
    messages = repair_conversations(df.filter("turn = 1")).first()["messages"]
    assert [tuple(m) for m in messages] == [("I", "user", ""), ("K", "assistant", "Ho.")]


def test_very_long_texts_and_conversation(spark):
    rows = [(9, t, "user", "w " * 100_000 + f"{t}.") for t in range(30)] + [(9, 100 + t, ["user", "assistant"][t % 2], f"{t}.") for t in range(5000)]
    got = answer(repair_conversations(spark.createDataFrame(rows, SCHEMA)))[9]
    assert got[:5] == (70, 0, 0, 0, 30) and len(got[6]) >= 5030
