"""Page reading on hand-made and given pages."""

from pyspark.sql import functions as F

from driftloom.operators import pages as G
from driftloom.plans.adapters import table


def read(html):
    return G.PageReader(html)


def test_visible_text_drops_boilerplate():
    page = read("<nav><aside>x</aside>menu</nav><p>Hello<b>big</b> <!-- c -->world&amp;co</p><script>var a='</p>'</script><footer>f")
    assert page.visible() == "Hello big world&co"


def test_focused_text_is_tag_major_and_repeats_nested():
    page = read("<p>one <a>two</a></p><h1>Top</h1><div>skip</div><button>go</button>")
    assert page.focused(["h1", "h2", "h3", "p", "button", "a"]) == "Top one two go two"


def test_unclosed_paragraphs_nest():
    assert read("<div><p>a<p>b</div>c").focused(["p"]) == "a b b"


def test_stray_end_tags_are_ignored():
    assert read("</p>a</div><p>b</p>").visible() == "a b"


def test_article_titles():
    html = "<article><h2><a href='/x'>Big <b>news</b></a></h2></article><article><p>no heading</p></article><article><h4>Plain</h4></article>"
    assert read(html).article_titles() == ["Bignews | /x", "Plain | "]


def test_article_titles_fallback():
    html = "<h2><a href='/a'>A long enough title</a></h2><h3><a href='/b'>short</a></h3><h2>No link at all here</h2><h3><a>Without any href</a></h3>"
    assert read(html).article_titles() == ["A long enough title | /a", "Without any href | "]
    assert len(read("<article><h1>t</h1></article>" * 60).article_titles()) == 50


def test_job_titles():
    html = "<ul><li class='Job-Listing x'>Data  Engineer</li><li class='job'>Dev</li><li class='job'>Data Engineer</li><div class='opening'>Support Lead</div></ul>"
    assert read(html).job_titles() == ["Data Engineer", "Support Lead"]
    assert read("<h2>Sales Manager</h2><h4>Ops</h4>").job_titles() == ["Sales Manager"]


def test_regex_text_equals_parsed_text(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    parsed = G.extract_pages(pages, ["page_id"]).select("page_id", "visible_text")
    plain = pages.select("page_id", G.visible_text(F.col("html")).alias("visible_text"))
    assert parsed.exceptAll(plain).count() == 0 and parsed.count() == pages.count()


def test_page_content(spark):
    rows = [("1", k, "<h1>Top</h1><article><h2>Bb</h2></article><article><h2>Aa</h2></article>") for k in ("homepage", "blog", "pricing", "careers")]
    df = spark.createDataFrame(rows, "entity_id string, page_type string, html string")
    out = {r.page_type: r for r in G.page_content(G.extract_pages(df, ["entity_id", "page_type"])).collect()}
    assert out["homepage"].content_text == "Top Bb Aa"
    assert out["blog"].content_text == "Aa | \nBb | " and out["blog"]["items"] == ["Bb | ", "Aa | "]
    assert out["pricing"].content_text == "Top Bb Aa"


def test_unknown_marked_sections_are_comments(spark):
    pages = [(1, "<p>a</p><![foo bar]>x"), (2, "<![if !IE]><p>b</p><![endif]>"), (3, "<p>c<![CDATA[d]]>"), (4, None), (5, "<!foo"), (6, "<![")]
    out = {r.page_id: (r.visible_text, r.error) for r in G.extract_pages(spark.createDataFrame(pages, "page_id long, html string"), ["page_id"], outputs=["visible_text"]).collect()}
    assert out[1] == ("a x", None) and out[2] == ("b", None) and out[4] == ("", None) and len(out) == 6


def test_title_limits_are_arguments(spark):
    html = "".join(f"<article><h1>t{i}</h1></article><li class='job'>Engineer {i}</li>" for i in range(120))
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    row = G.extract_pages(df, ["page_id"], titles=None, jobs=None).first()
    assert len(row.article_titles) == 120 and len(row.job_titles) == 120
    assert len(G.extract_pages(df, ["page_id"], titles=7).first().article_titles) == 7


def test_an_empty_error_is_no_error(spark):
    from driftloom.operators.state import usable_captures
    from driftloom.sources.inputs import capture_status

    df = spark.createDataFrame([("x", ""), ("x", None), ("x", "boom"), ("", None)], "content_text string, error string")
    assert usable_captures(df).count() == 2
    assert [r.status for r in capture_status(df.withColumnRenamed("content_text", "text")).collect()] == ["ok", "ok", "failed", "failed"]


OPEN_REFERENCE = "<title>Save &amp now&amp</title><article><h1>R&ampD &am &copy; &#38; &ampx; 5 & 6&amp</h1></article>"


def test_references_without_a_semicolon(spark):
    """What a cut title leaves of a reference is text in the reading that SQL has, and a character in the lenient one."""
    df = spark.createDataFrame([(1, OPEN_REFERENCE)], "page_id long, html string")
    lenient = G.extract_pages(df, ["page_id"]).first()
    assert lenient.visible_text == "Save & now& R&D &am \u00a9 & &x; 5 & 6&"
    plain = G.extract_pages(df, ["page_id"], open_references=False).first()
    assert plain.visible_text == "Save &amp now&amp R&ampD &am \u00a9 & &ampx; 5 & 6&amp"
    assert plain.article_titles == ["R&ampD &am \u00a9 & &ampx; 5 & 6&amp | "]


def cut_pages(spark, folder):
    """A folder of given tables: one page whose title and heading were cut inside a reference."""
    html = "<title>One &amp; two&amp</title><article><h1>One &amp; two&amp</h1><p>text &amp; more</p></article>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    import duckdb

    from driftloom.plans.catalog import QUERIES
    from driftloom.plans.oracles import ORACLES
    from tests.compare import compare

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return compare(spark, con, folder, QUERIES[name], ORACLES[name])


def test_bad_pages_with_cut_references_equal_sql(spark, tmp_path):
    assert against_sql(spark, cut_pages(spark, tmp_path), "b1_bad_pages") == ""


def test_parsed_text_with_cut_references_equals_sql(spark, tmp_path):
    assert against_sql(spark, cut_pages(spark, tmp_path), "b1_visible_text_parsed") == ""


def test_focused_text_with_cut_references_equals_sql(spark, tmp_path):
    assert against_sql(spark, cut_pages(spark, tmp_path), "b2_focused_text") == ""


def test_article_titles_with_cut_references_equal_sql(spark, tmp_path):
    assert against_sql(spark, cut_pages(spark, tmp_path), "b3_article_titles") == ""
