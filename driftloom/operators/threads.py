"""Comment trees flattened to reading order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.text import strip
from driftloom.operators.segments import lag_over
from driftloom.session import ensure_checkpoint_dir
from driftloom.sources.tables import owned_tables, written


def reading_order(comments: DataFrame) -> DataFrame:
    """Each comment's ``ord`` in its post's reading order (from 0), ``depth`` (roots have 0) and ``place``.

    ``comments`` has post_id, comment_id (unique in a post), parent_id and pos (order among siblings, ties by
    comment_id). A walk around each tree enters and leaves every comment once; what follows on entering or leaving is
    known from the comment before among its siblings, so the walk is a linked list. The list is ranked by pointer
    jumping: in each round a step takes over the sums and the pointer of the step it points at, so a walk of n steps
    takes log2(n) equi-joins of numbers, in which every key occurs once on either side, whatever the shape of the trees.
    Only numbers are kept, as many for a step at any depth.

    ``place`` is ``tree``, ``orphan`` below (and at) a comment whose parent is missing, which is then a root, or ``cycle``
    where following parents never ends; such comments have no ``ord`` and no ``depth``.
    """
    spark = comments.sparkSession
    with owned_tables(spark):
        own = comments.select("post_id", "comment_id", "parent_id", "pos", F.monotonically_increasing_id().alias("num"))
        own = written(own, "comments")
        known = own.select("post_id", F.col("comment_id").alias("parent_id"), F.col("num").alias("up"))
        nodes = own.join(known, ["post_id", "parent_id"], "left").select(
            "post_id", "num", "up", (F.col("parent_id").isNotNull() & F.col("up").isNull()).cast("int").alias("lost"),
            F.coalesce("up", F.lit(-1)).alias("_under"), F.struct("pos", "comment_id").alias("_at"),
        )
        nodes = written(lag_over(nodes, ["post_id", "_under"], "_at", "num", "before").drop("_at", "_under"), "siblings")

        enter, leave = F.col("num") * 2, F.col("num") * 2 + 1
        follows = F.when(F.col("before").isNotNull(), F.col("before") * 2 + 1).otherwise(F.col("up") * 2)
        links = nodes.select(follows.alias("step"), enter.alias("next")).filter("step is not null")
        # Where no comment follows: a comment without replies is left again, the last reply leads back to its parent.
        steps = nodes.select(
            enter.alias("step"), leave.alias("back"), F.lit(1).alias("n"), F.lit(1).alias("up"), F.col("lost")
        ).unionByName(nodes.select(leave.alias("step"), (F.col("up") * 2 + 1).alias("back"), F.lit(0).alias("n"), F.lit(-1).alias("up"), (-F.col("lost")).alias("lost")))
        sums = [F.col(c).cast("bigint").alias(c) for c in ("n", "up", "lost")]
        state = written(steps.join(links, "step", "left").select("step", F.coalesce("next", "back").alias("ptr"), *sums), "walk")
        longest = own.groupBy("post_id").count().agg(F.max("count")).first()[0] or 0
        for _ in range((2 * longest).bit_length()):  # after these, only cycles have a pointer
            todo = state.filter("ptr is not null")
            if todo.isEmpty():
                break
            ahead = state.select(F.col("step").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in ("n", "up", "lost")])
            moved = todo.join(ahead, "ptr").select("step", F.col("_ptr").alias("ptr"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("n", "up", "lost")])
            state = written(state.filter("ptr is null").unionByName(moved), "walk")

        # Sums from a step to the end of its walk: comments still to come, and what is open before it, negative.
        ranked = state.filter("step % 2 = 0").select((F.col("step") / 2).cast("bigint").alias("num"), "ptr", "n", (-F.col("up")).alias("depth"), (-F.col("lost")).alias("inside"))
        ranked = own.select("post_id", "comment_id", "num").join(nodes.select("num", "lost"), "num").join(ranked, "num")
        totals = ranked.filter("ptr is null").groupBy("post_id").agg(F.max("n").alias("all"))
        ranked = ranked.join(totals, "post_id", "left")
        ends = F.col("ptr").isNull()
        place = F.when(~ends, "cycle").when((F.col("inside") > 0) | (F.col("lost") > 0), "orphan").otherwise("tree")
        return written(ranked.select(
            "post_id", "comment_id", F.when(ends, F.col("all") - F.col("n")).alias("ord"), F.when(ends, F.col("depth")).alias("depth"), place.alias("place")
        ), "reading-order", keep=True)


def comment_paths(comments: DataFrame) -> DataFrame:
    """Each comment's root-to-node path and ``place``, for callers who want the paths themselves.

    All paths together grow with the square of a thread's depth; :func:`reading_order` does not need them.

    ``comments`` has post_id, comment_id, parent_id and pos (order among siblings). Paths grow by
    pointer doubling: every round joins each unfinished node to the node it points at and takes
    over that node's path and pointer, so a thread of depth d needs log2(d) equi-joins. Rounds are
    cut with checkpoint() in the shared folder and go on until every pointer has ended.

    ``place`` is ``tree``, ``orphan`` when an ancestor is missing (the topmost known one is then the
    root), or ``cycle`` when following parents never ends (the path is then the comment itself).
    """
    ensure_checkpoint_dir(comments.sparkSession)
    step = F.array(F.struct(F.col("pos"), F.col("comment_id")))
    known = comments.select("post_id", F.col("comment_id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    sizes = comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("_size"))
    state = (
        comments.select("post_id", "comment_id", "parent_id", step.alias("path")).join(known, ["post_id", "parent_id"], "left")
        .join(sizes, "post_id")
        .select(
            "post_id", "comment_id", F.when(F.col("_known"), F.col("parent_id")).alias("ptr"), "path", F.col("path").alias("_own"),
            (F.col("parent_id").isNotNull() & F.col("_known").isNull()).alias("_orphan"), F.lit(1).cast("bigint").alias("_steps"), "_size",
        )
        .checkpoint()
    )
    # A path longer than its post has comments is a cycle; it is not made any longer.
    while not state.filter(F.col("ptr").isNotNull() & (F.col("_steps") <= F.col("_size"))).isEmpty():
        open_nodes = state.filter(F.col("ptr").isNotNull())
        target = state.select(
            "post_id", F.col("comment_id").alias("ptr"), F.col("ptr").alias("_next"), F.col("path").alias("_prefix"),
            F.col("_orphan").alias("_cut"), F.col("_steps").alias("_more"),
        )
        longer = F.col("_steps") + F.col("_more")
        moved = open_nodes.join(target, ["post_id", "ptr"]).select(
            "post_id", "comment_id", F.col("_next").alias("ptr"),
            F.when(longer <= F.col("_size"), F.concat("_prefix", "path")).otherwise(F.col("path")).alias("path"), "_own",
            F.col("_cut").alias("_orphan"), longer.alias("_steps"), "_size",
        )
        state = state.filter(F.col("ptr").isNull()).unionByName(moved).checkpoint()
    cycle = F.col("ptr").isNotNull()
    place = F.when(cycle, "cycle").when(F.col("_orphan"), "orphan").otherwise("tree")
    return state.select("post_id", "comment_id", F.when(cycle, F.col("_own")).otherwise(F.col("path")).alias("path"), place.alias("place"))


def flatten_comments(comments: DataFrame, paths: bool = False) -> DataFrame:
    """Readable comments with their order inside the post, ``depth`` and ``place`` (see :func:`reading_order`); or their ``path``.

    Blank and deleted bodies are dropped, their replies are kept. With a ``kind`` column, only comments (``t1``) are readable.
    """
    body = strip(F.coalesce("body", F.lit("")))
    kept = comments.filter((body != "") & ~body.isin(*V.DELETED_BODIES))
    if "kind" in comments.columns:
        kept = kept.filter(F.col("kind") == "t1")
    placed = comment_paths(comments) if paths else reading_order(comments)
    return kept.select("post_id", "comment_id", body.alias("body")).join(placed, ["post_id", "comment_id"])


def _children(data: object) -> list:
    below = data.get("data") if isinstance(data, dict) else None
    below = below.get("children") if isinstance(below, dict) else None
    return below if isinstance(below, list) else []


def _walk(children: list) -> Iterator[str]:
    """Bodies of comment nodes in reading order; an explicit stack copes with any depth."""
    stack = [iter(children)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        if not isinstance(node, dict) or node.get("kind") != "t1":
            continue
        data = node.get("data")
        if not isinstance(data, dict):
            continue
        body = data.get("body")
        body = body.strip() if isinstance(body, str) else ""
        if body and body not in V.DELETED_BODIES:
            yield body
        stack.append(iter(_children(data.get("replies"))))


#: What makes one JSON value out of nested ones, for payloads nested deeper than the parser goes.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\s\[\]{}:,"]+', re.S)


def _load(payload: str) -> object:
    """The payload's value; deep nesting is put together with a stack instead of recursion."""
    try:
        return json.loads(payload)
    except RecursionError:
        pass
    done: list = []
    stack: list[tuple[object, list]] = []
    items = done
    for token in _TOKEN.findall(payload):
        if token in "[{":
            stack.append((token, items))
            items = []
        elif token in "]}":
            if not stack or (stack[-1][0] == "[") != (token == "]"):
                raise ValueError("unbalanced")
            kind, outer = stack.pop()
            if kind == "{" and len(items) % 2:
                raise ValueError("odd object")
            outer.append(items if kind == "[" else dict(zip(items[::2], items[1::2], strict=True)))
            items = outer
        elif token not in ",:":
            items.append(json.loads(token))
    if stack or len(done) != 1:
        raise ValueError("unfinished")
    return done[0]


def _bodies(payload: str) -> tuple[list[str], bool]:
    """Readable bodies, and whether the payload could be read."""
    try:
        parsed = _load(payload)
    except (TypeError, ValueError):
        return [], False
    if not isinstance(parsed, list) or len(parsed) < 2:
        return [], False
    return list(_walk(_children(parsed[1]))), True


def parse_comment_payloads(payloads: DataFrame, unreadable: bool = False) -> DataFrame:
    """One row per readable comment of each raw nested payload (post_id, payload).

    With ``unreadable``, a payload that cannot be read is one row more, without ``ord`` and ``body``.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for post, payload in zip(pdf["post_id"], pdf["payload"]):
                bodies, read = _bodies(payload)
                rows += [(post, i, body) for i, body in enumerate(bodies)]
                if unreadable and not read:
                    rows.append((post, None, None))
            yield pd.DataFrame(rows, columns=["post_id", "ord", "body"]).astype({"ord": "Int64"})

    return payloads.select("post_id", "payload").mapInPandas(
        explode, "post_id string, ord bigint, body string"
    )
