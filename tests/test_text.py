"""Text rules against plain Python and known cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftloom.functions import ids, recency
from driftloom.functions import predicates as P
from driftloom.functions import summaries as M
from driftloom.functions import text as X
from driftloom.functions import weeks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    row = tuple(values.values()) or (None,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


ODD = " a b\x1cc\x85d  e\t\nf  "


def test_whitespace_is_python_whitespace(spark):
    assert one(spark, X.collapse(F.col("t")), t=ODD) == " ".join(ODD.split())
    assert one(spark, X.strip(F.col("t")), t=ODD) == ODD.strip()


def test_lines(spark):
    text = "a\r\nb\x0bc  d \n\n e"
    want = [x.strip() for x in text.splitlines() if x.strip()]
    assert one(spark, X.stripped_lines(F.col("t")), t=text) == want


def test_sanitize_keeps_newline_and_tab(spark):
    text = "".join(chr(i) for i in range(40))
    assert one(spark, X.sanitize(F.col("t")), t=text) == "".join(c for c in text if c >= " " or c in "\n\t")


@pytest.mark.parametrize("text", ["", "short", "x" * 300, "word " * 60, "a, " * 100, "é " * 150, "Tail; " * 50])
def test_truncate_words(spark, text):
    flat = " ".join(text.split())
    if len(flat) > 140:
        head = flat[:140].rstrip()
        at = head.rfind(" ")
        head = head[:at] if at >= 60 else head
        flat = head.rstrip(" ,;:.") + "…"
    assert one(spark, X.truncate_note(F.col("t")), t=text) == flat


@pytest.mark.parametrize(
    "text", ["A sentence that is long enough to pass the sixty mark, surely. And then more words follow here", "x" * 130,
             "words with spaces but no sentence end " * 4, "Ab. " + "y" * 120]
)
def test_truncate_smart(spark, text):
    head = text[:100].rstrip()
    stop, space = max(head.rfind(c) for c in ".!?;"), head.rfind(" ")
    want = text if len(text) <= 100 else (
        head[: stop + 1].strip() if stop >= 60 else head[:space].rstrip() + "…" if space >= 40 else head + "…"
    )
    assert one(spark, X.truncate_smart(F.col("t"), 100), t=text) == want


def test_week_label_matches_strftime(spark):
    days = spark.sql("select explode(sequence(date'2019-12-25', date'2027-01-10')) d")
    for row in days.select("d", weeks.week_label(F.col("d")).alias("w")).collect():
        assert row.w == row.d.strftime("%Y-W%W")


@pytest.mark.parametrize(
    "label,recent",
    [("3d", True), ("1 week", True), ("2 weeks", False), ("1mo", False), ("Yesterday", True), ("January 1, 2020", False),
     ("5m", True), ("9d", False), ("1y", False), ("Jan 30, 2024", True), ("Dec 31", False), ("Jan 28", True),
     ("Feb 30, 2020", True), ("posted recently", True), ("", True), (None, True), ("7d", True), ("8 days ago", False),
     ("March 5, 2025", True), ("Sept 1, 2020", True), ("  JUST NOW ", True)],
)
def test_within_days(spark, label, recent):
    as_of = F.lit(str(datetime(2024, 2, 1, 8))).cast("timestamp_ntz")
    assert one(spark, recency.within_days(F.col("t"), 7, as_of), t=label) is recent


def test_yesterday_needs_a_day(spark):
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    assert one(spark, recency.within_days(F.col("t"), 0, as_of), t="yesterday") is False


def test_posted_label(spark):
    label = recency.posted_label(F.col("raws"), F.col("full"))
    assert one(spark, label, raws=["Acme", "Acme • 3d • Edited"], full="x 5h y") == "3d"
    assert one(spark, label, raws=["Acme"], full="seen 5h ago") == "5h"
    assert one(spark, label, raws=["Acme"], full="nothing here") is None


def test_company_urls(spark):
    url = ids.posts_url(F.col("i"), F.col("u"))
    base = "https://www.linkedin.com/company/"
    assert one(spark, url, i="12345", u=base + "example-company/") == base + "example-company/posts/?feedView=all"
    assert one(spark, url, i="12345", u=None) == base + "12345/posts/?feedView=all"
    assert one(spark, ids.candidate_urls(F.col("i"), F.col("u")), i="12345", u=base + "12345/posts/") == [
        base + "12345/posts/?feedView=all", base + "12345/posts/?feedView=all&viewAsMember=true", base + "12345/",
    ]


def test_item_id_prefers_activity(spark):
    col = ids.item_id(F.col("u"), F.col("t"), F.lit("1d"))
    assert one(spark, col, u="https://www.linkedin.com/feed/update/urn:li:activity:7346333881796405248/", t="text") == "7346333881796405248"


def test_page_state(spark):
    state = one(spark, P.page_state(F.col("t")), t="Sign in to LinkedIn. Complete security verification challenge.")
    assert state == "sign-in,security-verification,challenge"
    assert one(spark, P.page_state(F.col("t")), t=" ") == "empty-body"


@pytest.mark.parametrize("text,hit", [("tiers", False), ("prices", False), ("costs $199", False), ("credit-based", True),
                                      ("99/month", True), ("a$5", True), ("plané", False)])
def test_callout_word_ends(spark, text, hit):
    assert one(spark, P.is_pricing_callout(F.col("t")), t=text) is hit


def test_compact_bullets(spark):
    raw = "• First signal on pricing. • Second signal on home services targeting. • Third signal with risk note."
    out = one(spark, M.compact_bullets(F.col("t"), 3, 120), t=raw)
    assert len(out.splitlines()) == 3 and "Second signal on home services targeting." in out
    long = "• Managed services pricing changed significantly across enterprise bundles with multi-year minimum commitments."
    cut = one(spark, M.compact_bullets(F.col("t"), 1, 55), t=long)
    assert cut == "• Managed services pricing changed significantly across…"
    steps = "Step 1 extract\nnoise\nStep 3 synthesize\n• One\n• Two\n• **Three**\n- one"
    assert one(spark, M.compact_bullets(F.col("t"), 3, 50), t=steps) == "• One\n• Two\n• Three"
    assert one(spark, M.compact_bullets(F.col("t")), t="Important: x") == "• Summary unavailable"
    assert one(spark, M.compact_bullets(F.col("t")), t=None) == ""


def test_inline_bullets_split_where_a_mark_begins(spark):
    entries = lambda t: one(spark, M.inline_bullets(F.col("t")), t=t)
    assert entries("a • b\n\n c 3) d") == ["a", "• b", "c", "3) d"]
    assert entries("12. x") == ["1", "2. x"]
    assert entries("v1.2 and •x, 7.\n• ") == ["v1.2 and •x, 7.", "•"]
    assert entries("1" * 300_000) == ["1" * 300_000]
    assert entries(" \n\t") == []


def test_points_after_a_synthesis_line_stand_alone_if_enough(spark):
    text = "• a\n• b\nStep 3\n• c\n• C\n• d"
    read = M.bullet_points(F.col("t"), 6)
    shown = lambda n: one(spark, M.bullets(read, n), t=text)
    assert shown(2) == "• c\n• d"
    assert shown(3) == "• c\n• d"  # three late points, two of them alike
    assert shown(4) == "• c\n• d\n• a\n• b"
    for n in (2, 3, 4):
        assert one(spark, M.compact_bullets(F.col("t"), n), t=text) == shown(n)


def test_sentences_stand_in_for_points(spark):
    assert one(spark, M.compact_bullets(F.col("t"), 2), t="Normalize: One.  Two! Three?") == "• Two!\n• Three?"
    many = "Step 1 " + "word. " * 20_000 + "Last one?"
    assert one(spark, M.compact_bullets(F.col("t"), 2), t=many) == "• word.\n• Last one?"


def test_fit_bullets(spark):
    bullets = "\n".join("• " + c * 120 for c in "ABC")
    out = one(spark, M.fit_bullets(F.col("t"), 240), t=bullets)
    assert out.splitlines()[-1] == "• Additional points truncated for Slack length." and "C" * 60 not in out
    assert one(spark, M.fit_bullets(F.col("t"), 10), t="plain text here") == "plain text here"


def test_normalize_card(spark):
    raw = ("Competitor: Acme Corp\nSignals:\n• Shifted homepage CTA to AI voice receptionist bundles.\n### Note\n"
           "2) Targeting plumbers and HVAC with seasonal offer language.")
    out = one(spark, M.normalize_card(F.col("t"), F.lit("Acme Corp")), t=raw)
    assert out == ("Competitor: Acme Corp\nSignals:\n- Shifted homepage CTA to AI voice receptionist bundles.\n- ### Note\n"
                   "- Targeting plumbers and HVAC with seasonal offer language.")


def test_ensure_pricing(spark):
    col = M.ensure_pricing(F.col("t"), F.col("b"), 4)
    plain = "• Messaging shifted.\n• Audience moved."
    assert one(spark, col, t=plain, b="• TechDesk pricing update: x.").splitlines()[0] == "• TechDesk pricing update: x."
    priced = "• Shifted to credit-based pricing.\n• Other."
    assert one(spark, col, t=priced, b="• B.") == priced
    assert one(spark, col, t=plain, b=None) == plain


def test_append_bullet_trims_the_front(spark):
    assert one(spark, M.append_bullet(F.col("t"), F.lit(" d "), 3), t="a\nb\nc") == "b\nc\nd"
    assert one(spark, M.append_bullet(F.col("t"), F.lit("d"), 3), t=None) == "d"


def test_signal_line(spark):
    assert one(spark, M.signal_line(F.col("t"), 20), t="Step 1 x\nSignals:\n- **Bold**  move here today") == "Bold move here today"
    assert one(spark, M.signal_line(F.col("t")), t="***") == ""
    assert one(spark, M.signal_line(F.col("t")), t="Signals:") == "Signals:"


def test_long_bullets_split_a_text_once(spark):
    from driftloom.plans.catalog import long_bullets

    plan = long_bullets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
