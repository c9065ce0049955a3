"""Forum posts, comments and entities: known cases."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.operators import posts as O
from driftloom.operators import threads as H
from driftloom.sources import inputs as I


def listing(*posts):
    children = [
        {"data": {"id": i, "title": t, "selftext": b, "subreddit": s, "permalink": f"/r/{s}/comments/{i}/", "created_utc": 1767225600}}
        for i, t, b, s in posts
    ]
    return json.dumps({"data": {"children": children, "after": None}})


def parsed(spark, payload):
    return I.parse_listing(spark.createDataFrame([(payload,)], "payload string"), "payload")


def ids_of(df):
    return [r.post_id for r in df.orderBy("pos").collect()]


def test_pricing_posts(spark):
    df = parsed(spark, listing(("a1", "Acme quote", "We paid $99 per month", "smallbusiness"), ("a2", "Acme", "no numbers", "smallbusiness"),
                               ("a3", "Acme", "$199", "stocks")))
    out = O.filter_posts(df, "pricing").collect()
    assert [r.post_id for r in out] == ["a1"]
    assert out[0].date == "2026-01-01" and out[0].url == "https://www.reddit.com/r/smallbusiness/comments/a1/"


def test_discussion_posts(spark):
    df = parsed(spark, listing(("d1", "Acme review: worth it?", "", "smallbusiness"), ("d2", "I work at Acme", "the salary is low", "jobs")))
    assert ids_of(O.filter_posts(df, "discussion")) == ["d1"]


def test_channel_lists(spark):
    df = parsed(spark, listing(("a", "x", "$5", "smallbusiness"), ("b", "x", "$5", "HVAC")))
    assert ids_of(O.filter_posts(df, "pricing", allow=["SmallBusiness "])) == ["a"]
    assert ids_of(O.filter_posts(df, "pricing", deny=["hvac"])) == ["a"]


@pytest.mark.parametrize("payload", ["not json", "[]", '{"data": {"children": "x"}}', "null", '{"error": 404}'])
def test_malformed_listing_yields_nothing(spark, payload):
    assert parsed(spark, payload).count() == 0


def ranked(spark, mode, *bodies):
    rows = [("p", i, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "post_id string, ord long, body string")
    return [r.body for r in O.rank_comments(df, mode).orderBy("rank").collect()]


def test_comment_ranking(spark):
    assert ranked(spark, "pricing", "General comment", "We paid $299 per month") == ["We paid $299 per month", "General comment"]
    out = ranked(spark, "discussion", "I work at that place as employee", "Neutral words", "As a customer, reliable", "customer and employee")
    assert out == ["As a customer, reliable", "customer and employee", "Neutral words"]
    assert len(ranked(spark, "pricing", *["c"] * 20)) == 8
    assert len(ranked(spark, "pricing", "x" * 900)[0]) == 400


def node(body, *replies, kind="t1"):
    data = {"body": body}
    data["replies"] = {"data": {"children": list(replies)}} if replies else ""
    return {"kind": kind, "data": data}


def test_raw_comment_payload(spark):
    tree = [{}, {"data": {"children": [
        node("one", node("[deleted]", node(" two ")), node("more", kind="more")), node("", node("three")), node("four")]}}]
    df = spark.createDataFrame([("p", json.dumps(tree)), ("q", "oops"), ("r", "[]"), ("s", '{"a":1}')], "post_id string, payload string")
    out = [(r.post_id, r.body) for r in H.parse_comment_payloads(df).orderBy("ord").collect()]
    assert out == [("p", "one"), ("p", "two"), ("p", "three"), ("p", "four")]


def test_tree_order_is_preorder_at_any_depth(spark):
    chain = [("deep", i, i - 1 if i else None, 0, f"c{i}") for i in range(70)]
    bushy = [("b", 0, None, 5, "r2"), ("b", 1, None, 1, "r1"), ("b", 2, 1, 9, "r1b"), ("b", 3, 1, 2, "[removed]"), ("b", 4, 3, 0, "kept"),
             ("b", 5, 99, 9, "orphan")]
    df = spark.createDataFrame(chain + bushy, "post_id string, comment_id long, parent_id long, pos long, body string")
    out = H.flatten_comments(df).orderBy("post_id", "ord").collect()
    assert [r.body for r in out if r.post_id == "b"] == ["r1", "kept", "r1b", "r2", "orphan"]
    assert [r.body for r in out if r.post_id == "deep"] == [f"c{i}" for i in range(70)]


def test_orphans_and_cycles_are_kept_and_named(spark):
    rows = [("p", 1, 2, 0, "a"), ("p", 2, 1, 0, "b"), ("p", 3, 2, 0, "behind"), ("p", 4, None, 0, "root"), ("q", 5, 99, 0, "lost"), ("q", 6, 5, 0, "below")]
    df = spark.createDataFrame(rows, "post_id string, comment_id long, parent_id long, pos long, body string")
    paths = H.comment_paths(df).withColumnRenamed("path", "ord")
    out = {r.comment_id: (r.place, [p.comment_id for p in r.ord]) for r in paths.collect()}
    assert out == {1: ("cycle", [1]), 2: ("cycle", [2]), 3: ("cycle", [3]), 4: ("tree", [4]), 5: ("orphan", [5]), 6: ("orphan", [5, 6])}
    out = {r.comment_id: (r.place, r.ord, r.depth) for r in H.flatten_comments(df).collect()}
    assert out == {1: ("cycle", None, None), 2: ("cycle", None, None), 3: ("cycle", None, None), 4: ("tree", 0, 0), 5: ("orphan", 0, 0), 6: ("orphan", 1, 1)}


SHAPE = "post_id string, comment_id long, parent_id long, pos long, body string"


def test_a_thread_deeper_than_any_bound(spark):
    df = spark.range(50_000).selectExpr(
        "'deep' as post_id", "id as comment_id", "if(id = 0, null, id - 1) as parent_id", "0L as pos", "concat('c', id) as body"
    )
    order = H.reading_order(df)
    assert order.filter("ord = comment_id and depth = comment_id and place = 'tree'").count() == 50_000
    assert {t for _, t in order.dtypes} <= {"string", "bigint"}  # no paths


@pytest.mark.parametrize("seed", [1, 2])
def test_reading_order_of_any_forest(spark, seed):
    rng = random.Random(seed)
    rows = []
    for post in "abcd":
        n = {"a": 1, "b": 40, "c": 300, "d": 120}[post]
        ids = rng.sample(range(1000), n)
        for i, c in enumerate(ids):
            parent = None if i == 0 or rng.random() < 0.1 else 5000 if rng.random() < 0.05 else ids[rng.randrange(max(0, i - (3 if post == "c" else 99)), i)]
            rows.append((post, c, parent, rng.randrange(3), "x"))
        if post == "d":
            rows += [(post, 2000, 2001, 0, "x"), (post, 2001, 2000, 0, "x"), (post, 2002, 2001, 0, "x")]
    below, known = defaultdict(list), {(p, c) for p, c, *_ in rows}
    for p, c, up, pos, _ in rows:
        below[p, up if (p, up) in known else None].append((pos, c, up is not None and (p, up) not in known))
    want = {(p, c): (None, None, "cycle") for p, c, *_ in rows}
    for post in "abcd":
        stack, ord_ = [(*r, 0) for r in sorted(below[post, None], reverse=True)], 0
        while stack:
            _, c, lost, depth = stack.pop()
            want[post, c] = (ord_, depth, "orphan" if lost else "tree")
            ord_ += 1
            stack += [(pos, child, lost, depth + 1) for pos, child, _ in sorted(below[post, c], reverse=True)]
    got = {(r.post_id, r.comment_id): (r.ord, r.depth, r.place) for r in H.reading_order(spark.createDataFrame(rows, SHAPE).repartition(5)).collect()}
    assert got == want
    assert H.reading_order(spark.createDataFrame([], SHAPE)).count() == 0


def test_only_comments_are_readable(spark):
    df = spark.createDataFrame([("p", 1, None, 0, "a", "t1"), ("p", 2, 1, 0, "more", "more"), ("p", 3, 2, 0, "c", "t1")],
                               "post_id string, comment_id long, parent_id long, pos long, body string, kind string")
    assert [r.body for r in H.flatten_comments(df).orderBy("ord").collect()] == ["a", "c"]


def test_bad_comment_payloads_cost_only_themselves(spark):
    deep = '[{},{"data":{"children":[' + '{"kind":"t1","data":{"body":"x","replies":{"data":{"children":[' * 6000 + "]}}}}" * 6000 + "]}}]"
    odd = [{"kind": "t1", "data": {"body": 5}}, {"kind": "t1", "data": [1]}, {"kind": "t1", "data": {"body": "ok", "replies": {"data": [1]}}}]
    rows = [("deep", deep), ("odd", json.dumps([{}, {"data": {"children": odd}}])), ("list", "[" * 9000), ("data", '[{}, {"data": 7}]'), ("null", None)]
    df = spark.createDataFrame(rows, "post_id string, payload string")
    out = H.parse_comment_payloads(df, unreadable=True).groupBy("post_id").agg(F.count("body").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {r.post_id: (r.n, r["rows"]) for r in out} == {"deep": (6000, 6000), "odd": (1, 1), "list": (0, 1), "null": (0, 1)}


def test_counters_are_kept(spark):
    payload = '{"posts":[{"url":"u","likes":"1.2K","views":1.5,"shares":"lots","comments":null,"awards":"2,000","upvotes":7}]}'
    row = I.normalize_payload(spark.createDataFrame([(payload,)], "payload string"), "payload", F.lit("s"), F.lit(True)).first()
    assert row["engagement"] == {"likes": 1200, "views": 2, "awards": 2000, "upvotes": 7}
    assert row["engagement_raw"] == {"likes": "1.2K", "views": "1.5", "shares": "lots", "awards": "2,000", "upvotes": "7"}


def test_payload_lists(spark):
    cases = [
        ('{"posts":[],"tweets":[{"body":"b","username":"u"}]}', [("b", "u")]),
        ('{"posts":"oops","tweets":[{"body":"b"}]}', []),
        ('{"data":[{"text":"t","snippet":"","author":"a"},7,"x",{"text":"z"}]}', [("t", "a"), ("z", "")]),
        ("nope", []),
    ]
    for payload, want in cases:
        df = spark.createDataFrame([(payload,)], "payload string")
        from pyspark.sql import functions as F

        out = I.normalize_payload(df, "payload", F.lit("s"), F.lit(True)).orderBy("pos").collect()
        assert [(r.text, r.author) for r in out] == want


def test_queries_keep_first_spelling(spark):
    df = spark.createDataFrame([("1", "Acme", None, [" Cost ", "cost", "", "COST", "fee"]), ("2", "Bee", "B", [])],
                               "entity_id string, name string, search_term string, keywords array<string>")
    out = [(r.entity_id, r.query) for r in O.expand_queries(df, "pricing").orderBy("entity_id", "keyword_idx").collect()]
    assert out[:2] == [("1", '"Acme" "Cost"'), ("1", '"Acme" "fee"')] and len(out) == 8
    assert [r.query for r in O.expand_queries(df, "commentary").orderBy("entity_id", "keyword_idx").collect()] == [" Cost ", "cost", "B"]


def test_attach_comments_only_to_leading_posts(spark):
    posts = spark.createDataFrame([("e", f"p{i}", i) for i in range(15)], "entity_id string, post_id string, pos long")
    lists = spark.createDataFrame([(f"p{i}", ["c"]) for i in range(15)], "post_id string, comments array<string>")
    out = {r.post_id: r.comments for r in O.attach_comments(posts, lists, ["pos"]).collect()}
    assert sum(bool(c) for c in out.values()) == 10 and len(out) == 15 and out["p9"] and not out["p10"]


def test_payload_lists_and_long_counters(spark):
    rows = [
        ('{"posts": [ ], "tweets":[{"text":"t","likes":9007199254740993,"views":"1.5K","shares":"12.7","comments":"+4"}]}',),
        ('[{"posts":[{"text":"in a list"}]}]',), ('{"posts":[{"text":"cut',), ('{"data":{"text":"no list"}}',), (None,), ("",),
    ]
    df = spark.createDataFrame(rows, "payload string")
    out = I.normalize_payload(df, "payload", F.lit("s"), F.lit(True)).collect()
    assert [r.text for r in out] == ["t"]
    assert out[0].engagement == {"likes": 9007199254740993, "views": 1500, "shares": 13}
