"""Text and item extraction from page HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.text import collapse

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HEADINGS = ("h1", "h2", "h3", "h4")
WATCHED = frozenset([*V.FOCUS_TAGS, "h4", "article", "li", "tr", "div"])
JOB_CLASS = re.compile(V.JOB_CLASS, re.I)
#: A character reference with its semicolon, or an ampersand that begins none.
REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([a-zA-Z][a-zA-Z0-9]*;))?")


class Element:
    """An element worth reading: its tag, attributes, enclosing watched elements and text pieces."""

    __slots__ = ("tag", "css", "href", "inside", "pieces")

    def __init__(self, tag: str, attrs: dict, inside: list[Element]):
        self.tag, self.inside, self.pieces = tag, inside, []
        self.css, self.href = attrs.get("class") or "", attrs.get("href") or ""

    def text(self, sep: str = " ") -> str:
        return sep.join(self.pieces)


class PageReader(HTMLParser):
    """One pass over a page: visible text pieces, and the text of every watched element.

    An element stays open until its end tag or that of an enclosing element, as lenient parsers do.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Element | None]] = []
        self.hidden = 0
        self.pieces: list[str] = []
        self.elements: list[Element] = []
        self.pending: list[str] = []
        self.error: str | None = None
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError, RecursionError) as broken:
            self.error = f"unreadable page: {broken}"
        self.end_text()

    def end_text(self) -> None:
        piece = "".join(self.pending).strip()
        self.pending = []
        if piece and not self.hidden:
            self.pieces.append(piece)
            for _, element in self.open:
                if element is not None:
                    element.pieces.append(piece)

    def handle_starttag(self, tag, attrs):
        self.end_text()
        if tag in VOID_TAGS:
            return
        element = None
        if tag in WATCHED and not self.hidden:
            element = Element(tag, dict(attrs), [e for _, e in self.open if e is not None])
            self.elements.append(element)
        self.hidden += tag in V.STRIP_TAGS
        self.open.append((tag, element))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_text()
        if any(name == tag for name, _ in self.open):
            while True:
                name, _ = self.open.pop()
                self.hidden -= name in V.STRIP_TAGS
                if name == tag:
                    break

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.end_text()

    def unknown_decl(self, data):
        self.end_text()

    def parse_marked_section(self, i, report=1):
        """Any marked section (``<![...]>``) is a comment up to its end, whatever its keyword."""
        end = self.rawdata.find(">", i)
        if end < 0:
            return -1
        self.end_text()
        return end + 1

    # --- What is read off the page ---

    def tagged(self, *tags: str) -> list[Element]:
        return [e for e in self.elements if e.tag in tags]

    def visible(self) -> str:
        return squeeze(" ".join(self.pieces))

    def focused(self, tags: list[str]) -> str:
        found = (e.text() for tag in tags for e in self.tagged(tag))
        return squeeze(" ".join(t for t in found if t))

    def first_inside(self, tags: tuple[str, ...], outer: str) -> dict[int, Element]:
        """Of each element with the tag ``outer``, the first element with one of ``tags`` that it encloses."""
        found: dict[int, Element] = {}
        for element in self.tagged(*tags):
            for e in element.inside:
                if e.tag == outer:
                    found.setdefault(id(e), element)
        return found

    def article_titles(self, most: int | None = 50) -> list[str]:
        titles = []
        headings = self.first_inside(HEADINGS, "article")
        links: dict[int, Element] = {}
        for link in self.tagged("a"):
            for e in link.inside:
                if e.tag in HEADINGS:
                    links.setdefault(id(e), link)
        for article in self.tagged("article"):
            heading = headings.get(id(article))
            if heading is not None and heading.pieces:
                link = links.get(id(heading))
                titles.append(f"{heading.text('')} | {link.href if link else ''}")
        if not titles:
            for heading in self.tagged("h2", "h3"):
                link = links.get(id(heading))
                if link is not None and len(heading.text("")) > 10:
                    titles.append(f"{heading.text('')} | {link.href}")
        return titles[:most]

    def job_titles(self, most: int | None = 100) -> list[str]:
        rows = [e.text() for e in self.tagged("li", "tr", "div") if JOB_CLASS.search(e.css)]
        jobs = [squeeze(t) for t in rows if 5 < len(t) < 200]
        if not jobs:
            texts = [h.text("") for h in self.tagged("h2", "h3", "h4")]
            jobs = [t for t in texts if 5 < len(t) < 150]
        return list(dict.fromkeys(jobs))[:most]


def closed_references(html: str) -> str:
    """The page with every ampersand written out that begins no reference closed by a semicolon."""
    return REFERENCE.sub(lambda m: m[0] if m[1] in html5 or m[0].startswith("&#") else f"&amp;{m[0][1:]}", html)


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


OUTPUTS = {
    "visible_text": "string", "focused_text": "string", "article_titles": "array<string>", "job_titles": "array<string>",
}


def extract_pages(
    pages: DataFrame, keys: list[str], html: str = "html", outputs: list[str] | None = None, titles: int | None = 50,
    jobs: int | None = 100, open_references: bool = True,
) -> DataFrame:
    """What is asked for of ``OUTPUTS`` (default: all) of every page, in one pass, and ``error`` of an unreadable page.

    ``titles`` and ``jobs`` limit the lists that are put out (None: all); pages are always read whole. A page that
    the tokenizer gives up on keeps what was read before, and its ``error`` makes the capture a failed one. Lenient
    parsers also read a reference without its semicolon (``&amp``); without ``open_references`` it is plain text, as in
    :func:`visible_text`.
    """
    outputs = list(OUTPUTS) if outputs is None else outputs
    types = dict(pages.select(*keys).dtypes)
    readers = {
        "visible_text": PageReader.visible, "focused_text": lambda p: p.focused(V.FOCUS_TAGS),
        "article_titles": lambda p: p.article_titles(titles), "job_titles": lambda p: p.job_titles(jobs),
    }

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            found = []
            for page in pdf[html]:
                reader = PageReader((page or "") if open_references else closed_references(page or ""))
                found.append([readers[o](reader) for o in outputs] + [reader.error])
            for i, name in enumerate([*outputs, "error"]):
                out[name] = [row[i] for row in found]
            yield out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{o} {OUTPUTS[o]}" for o in outputs] + ["error string"])
    return pages.select(*keys, html).mapInPandas(read, schema)


def visible_text(html: Column) -> Column:
    """Visible text without leaving the JVM, for pages whose stripped tags do not nest in
    themselves and whose entities are the few named below; :func:`extract_pages` reads any page."""
    tags = "|".join(V.STRIP_TAGS)
    out = F.regexp_replace(html, rf"(?is)<({tags})\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[!/a-zA-Z][^>]*>", " ")
    for entity, char in (
        ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"),
        ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def list_page_text(items: Column, fallback: Column) -> Column:
    """Content of a list page: its items in sorted order, else the whole text."""
    return F.when(F.size(items) > 0, F.array_join(F.array_sort(items), "\n")).otherwise(fallback)


def page_content(extracted: DataFrame) -> DataFrame:
    """Stored text and items by page type."""
    kind = F.col("page_type")
    empty = F.array().cast("array<string>")
    items = (
        F.when(kind == "blog", F.col("article_titles"))
        .when(kind == "careers", F.col("job_titles"))
        .otherwise(empty)
    )
    text = F.when(kind == "homepage", F.col("focused_text")).otherwise(
        list_page_text(items, F.col("visible_text"))
    )
    return extracted.withColumns({"items": items, "content_text": text})
