"""Chat formatting: links tool calls with their results, orders messages, validates arguments, writes canonical JSON.

An assistant's text may be an object with ``tool_calls``: [{"id", "name", "arguments", "after": [ids]}] and
``content``; a tool's text an object with ``tool_call_id`` and ``content``. Any other text is plain content.
A result comes after its call, and a call after the results of the calls that its ``after`` names. Messages
keep the order of their turns as far as that allows.

Null texts are empty content, null roles are written as null, messages without conv_id or turn have no links
(and no order of their own); of several calls with one id in a conversation the first is meant; repeated rows
are written each for itself. Extra columns play no part. Nothing is gathered by conversation, so a very long
one is no single task's work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import written

#: Tool name -> schema of its arguments, for conversations that use these tools.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "read_page": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}

_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and characters as they are; lone surrogates stay escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.encode("utf-8", "backslashreplace").decode()


def fits(value: object, schema: dict) -> bool:
    """Whether a value has the schema's type, enum, required and known properties, and items."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds) if k in _TYPES):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(fits(value[k], s) for k, s in known.items() if k in value)
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        return all(fits(v, schema["items"]) for v in value)
    return True


def read_object(text: str | None) -> dict | None:
    if text is None or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def content_of(value: dict) -> object:
    """The content of a message object as it is, 0, false and empty lists too; only null or none is empty text."""
    content = value.get("content")
    return "" if content is None else content


def parse(role: str | None, text: str | None, tools: dict[str, dict]) -> tuple:
    """(json of the message, calls: (id, after, status), id of the call that it answers)."""
    value = read_object(text) if role in ("assistant", "tool") else None
    if role == "assistant" and value and isinstance(value.get("tool_calls"), list):
        calls, shown = [], []
        for call in value["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            key, name, arguments = call.get("id"), call.get("name"), call.get("arguments")
            after = [a for a in call.get("after") or [] if isinstance(a, str)] if isinstance(call.get("after"), list) else []
            schema = tools.get(name) if isinstance(name, str) else None
            status = "unknown_tool" if schema is None else "ok" if fits(arguments, schema) else "bad_arguments"
            calls.append((key if isinstance(key, str) else None, after, status))
            shown.append({"id": key, "name": name, "arguments": arguments})
        message = {"role": role, "content": content_of(value), "tool_calls": shown}
        return canonical(message), calls, None
    if role == "tool" and value and isinstance(value.get("tool_call_id"), str):
        message = {"role": role, "content": content_of(value), "tool_call_id": value["tool_call_id"]}
        return canonical(message), [], value["tool_call_id"]
    return canonical({"role": role, "content": text or ""}), [], None


def format_chat(messages: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, order_turn, order_step, json, n_calls, n_bad_calls, n_unanswered and status of every message.

    Sorting a conversation by (order_turn, order_step, turn) gives its order. status: ok, orphan_result (no such
    call), or cycle (calls and results wait for each other; the message keeps its turn).
    """
    tools = TOOLS if tools is None else tools
    call_type = "array<struct<call_id:string,after:array<string>,status:string>>"

    @F.pandas_udf(f"json string, calls {call_type}, answers string")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            rows = []
            for role, text in zip(roles, texts, strict=True):
                shown, calls, answers = parse(role, text, tools)
                rows.append((shown, [dict(zip(("call_id", "after", "status"), c, strict=True)) for c in calls], answers))
            yield pd.DataFrame(rows, columns=["json", "calls", "answers"])

    rows = messages.select(F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), parsed("role", "text").alias("m"))
    rows = written(rows.select("conv_id", "turn", "m.*"), "chat-messages")
    linked = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    calls = linked.select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", "c.*").filter("call_id is not null")
    first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    results = linked.filter("answers is not null").select("conv_id", F.col("turn").alias("result_turn"), F.col("answers").alias("call_id"))
    answered = written(results.join(first, ["conv_id", "call_id"], "left"), "chat-results")

    # Links between messages: (conv_id, earlier, later).
    down = answered.filter("call_turn is not null").select("conv_id", F.col("call_turn").alias("earlier"), F.col("result_turn").alias("later"))
    waits = calls.select("conv_id", "turn", F.explode("after").alias("call_id"))
    up = waits.join(answered.select("conv_id", "call_id", "result_turn"), ["conv_id", "call_id"])
    up = up.select("conv_id", F.col("result_turn").alias("earlier"), F.col("turn").alias("later"))
    links = written(down.unionByName(up).distinct(), "chat-links")
    placed = order_messages(links)

    told = answered.groupBy("conv_id", F.col("result_turn").alias("turn")).agg(F.max(F.col("call_turn").isNull()).alias("orphan"))
    have = answered.select("conv_id", "call_id").distinct().withColumn("found", F.lit(True))
    open_calls = calls.join(have, ["conv_id", "call_id"], "left").filter("found is null").groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("unanswered")
    )
    out = rows.join(placed, ["conv_id", "turn"], "left").join(told, ["conv_id", "turn"], "left").join(open_calls, ["conv_id", "turn"], "left")
    status = F.when(F.col("cycle"), "cycle").when(F.col("orphan") & F.col("answers").isNotNull(), "orphan_result").otherwise("ok")
    return out.select(
        "conv_id", "turn", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_step", F.lit(0).cast("bigint")).alias("order_step"),
        "json", F.size("calls").cast("bigint").alias("n_calls"),
        F.size(F.filter("calls", lambda c: c["status"] != "ok")).cast("bigint").alias("n_bad_calls"),
        F.when(F.size("calls") > 0, F.coalesce("unanswered", F.lit(0))).otherwise(0).cast("bigint").alias("n_unanswered"), status.alias("status"),
    )


def order_messages(links: DataFrame) -> DataFrame:
    """(conv_id, turn, order_turn, order_step, cycle) of the messages that are linked.

    Messages that wait for none are placed first, then those whose last predecessor is placed, and so on: as
    many rounds as the longest chain has messages. What is never free lies on a cycle or behind one.
    """
    names = ["conv_id", "turn"]
    nodes = links.select("conv_id", F.col("earlier").alias("turn")).union(links.select("conv_id", F.col("later").alias("turn"))).distinct()
    placed = nodes.select(*names, F.col("turn").alias("order_turn"), F.lit(0).cast("bigint").alias("order_step")).limit(0)
    rest = nodes
    while not rest.isEmpty():
        held = links.join(rest.select("conv_id", F.col("turn").alias("earlier")), ["conv_id", "earlier"], "left_semi")
        free = rest.join(held.select("conv_id", F.col("later").alias("turn")).distinct(), names, "left_anti")
        done = placed.select("conv_id", F.col("turn").alias("earlier"), "order_turn", "order_step")
        came = links.join(done, ["conv_id", "earlier"]).groupBy("conv_id", F.col("later").alias("turn")).agg(
            F.max(F.struct("order_turn", "order_step")).alias("p")
        )
        late = F.col("p.order_turn") >= F.col("turn")
        now = free.join(came, names, "left").select(
            *names, F.when(late, F.col("p.order_turn")).otherwise(F.col("turn")).alias("order_turn"),
            F.when(late, F.col("p.order_step") + 1).otherwise(0).cast("bigint").alias("order_step"),
        )
        now = written(now, "chat-placed")
        if now.isEmpty():
            break
        placed = written(placed.unionByName(now), "chat-placed")
        rest = written(rest.join(now.select(*names), names, "left_anti"), "chat-rest")
    stuck = rest.select(*names, F.col("turn").alias("order_turn"), F.lit(0).cast("bigint").alias("order_step"), F.lit(True).alias("cycle"))
    return placed.withColumn("cycle", F.lit(False)).unionByName(stuck)
