"""Following links for acronyms that the text itself leaves open."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.functions.text import url_join
from sparkronym.shipping import ship


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "abbr"):
            a = dict(attrs)
            self.open.append([tag, [], a.get("title"), a.get("href")])

    def handle_data(self, data):
        for o in self.open:
            o[1].append(data)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                kind, text, title, href = self.open.pop(k)
                self.out.append((kind, "".join(text).strip(), title, href))
                return


class _Text(HTMLParser):
    SKIP = ("script", "style", "head", "template")
    BREAK = ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def text_of(html: str) -> str:
    p = _Text()
    p.feed(html)
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


LINKS = "article_id string, url string, kind string, text string, title string, href string"


def links(pages: DataFrame) -> DataFrame:
    """(article_id, url, kind, text, title, href) of <a> and <abbr> in pages (article_id, url, html)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = _Links()
                p.feed(h or "")
                rows += [(i, u, *x) for x in p.out]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["article_id", "url", "kind", "text", "title", "href"])

    return pages.select(F.col("article_id").cast("string"), "url", "html").mapInArrow(run, LINKS)


def page_texts(pages: DataFrame) -> DataFrame:
    """(article_id, raw_text) of pages (article_id, html)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(h or "") for h in b.column(1).to_pylist()], pa.string())], names=["article_id", "raw_text"])

    return pages.select(F.col("article_id").cast("string"), "html").mapInArrow(run, "article_id string, raw_text string")


def followable(found: DataFrame) -> DataFrame:
    """Links to other pages, with their address."""
    return found.where("kind = 'a' and href is not null and not startswith(href, '#')").withColumn("target", url_join("url", "href"))


def titles(open_acronyms: DataFrame, found: DataFrame) -> DataFrame:
    """(article_id, acronym, expansion): from the title of an <abbr>, else of an <a>, whose text is the acronym."""
    o = open_acronyms.select("article_id", "acronym").distinct()
    t = found.where("title is not null and title <> ''").select("article_id", "kind", F.lower("text").alias("_t"), "title")
    j = o.join(t, (o["article_id"] == t["article_id"]) & (F.lower("acronym") == F.col("_t"))).select(o["article_id"], "acronym", "kind", "title")
    per = W.partitionBy("article_id", "acronym").orderBy(F.when(F.col("kind") == "abbr", 0).otherwise(1), "title")
    return j.withColumn("rank", F.row_number().over(per)).where("rank = 1").select("article_id", "acronym", F.col("title").alias("expansion"))


def follow(open_acronyms: DataFrame, found: DataFrame, pages: DataFrame, rule: str = "schwartz_hearst") -> DataFrame:
    """(article_id, acronym, expansion) by titles, then by what linked pages (a table, not the network) say of the
    acronym that is the link's text; of several the first by address."""
    from sparkronym.operators.extract import extract

    first = titles(open_acronyms, found)
    rest = open_acronyms.select("article_id", "acronym").distinct().join(first, ["article_id", "acronym"], "left_anti")
    out = followable(found)
    wanted = rest.join(out.select("article_id", F.lower("text").alias("_t"), "target"), "article_id").where(F.lower("acronym") == F.col("_t"))
    there = pages.select("url", "html").join(wanted.select(F.col("target").alias("url")).distinct(), "url", "left_semi")
    pairs = extract(page_texts(there.withColumn("article_id", F.col("url"))), rule).select(F.col("article_id").alias("target"), "acronym", "expansion")
    got = wanted.join(pairs, ["target", "acronym"])
    per = W.partitionBy("article_id", "acronym").orderBy("target", "expansion")
    got = got.withColumn("rank", F.row_number().over(per)).where("rank = 1").select("article_id", "acronym", "expansion")
    return first.unionByName(got)
