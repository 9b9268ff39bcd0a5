"""Links and text of HTML pages, and the listing rules of proceedings sites."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.finish()
            self.href, self.parts = dict(attrs).get("href") or "", []

    def handle_endtag(self, tag):
        if tag == "a":
            self.finish()

    def handle_data(self, data):
        if self.href is not None:
            self.parts.append(data)

    def finish(self) -> None:
        if self.href:
            self.links.append((self.href, " ".join("".join(self.parts).split())))
        self.href = None


def anchors(html: str | None) -> list[tuple[str, str]]:
    """(href, text) in document order; anchors without a target are left out."""
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    parser.finish()
    return parser.links


def extract_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, pos, href, link_text``: one row for each link, in Arrow batches."""
    kind = dict(pages.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, href, text) for i, html in part.itertuples(index=False) for n, (href, text) in enumerate(anchors(html))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href", "link_text"])

    return pages.select(id_col, html_col).mapInPandas(run, f"page_id {kind}, pos int, href string, link_text string")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.parts.append(" ".join(data.split()))


def plain_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(StringType())
def html_text_udf(html: pd.Series) -> pd.Series:
    """Cleaned text nodes, joined by spaces."""
    return html.map(plain_text)


def is_acl_paper(href: Column) -> Column:
    last = F.element_at(F.split(F.rtrim(href, F.lit("/")), "/"), -1)
    return last.rlike(r"(?i)^\d{4}\.[a-z0-9-]+\.\d+$") & ~F.lower(href).endswith(".pdf") & ~href.contains("#")


def is_cvf_paper(href: Column) -> Column:
    return href.contains("_paper.html")


def is_pmlr_paper(href: Column) -> Column:
    return href.rlike(r"/v\d+/[^/]+\.html$")


def acl_listing(links: DataFrame, title_filter: str | None = None) -> DataFrame:
    """Papers of a proceedings page: the first link of each record id that has a text."""
    rows = links.where(is_acl_paper(F.col("href")) & (F.col("link_text") != ""))
    rows = rows.withColumn("source_record_id", F.element_at(F.split(F.rtrim(F.col("href"), F.lit("/")), "/"), -1))
    if title_filter:
        rows = rows.where(F.lower("link_text").contains(title_filter.lower()))
    first = Window.partitionBy("page_id", "source_record_id").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("page_id", "pos", "source_record_id", F.col("link_text").alias("title"), F.col("href").alias("landing_url"))


def acl_proceedings(links: DataFrame, venue: str, year: int) -> DataFrame:
    """The first link of each venue page that leads to the proceedings of a year."""
    bare = F.lower(F.trim(F.col("href"), F.lit("/")))
    hit = links.where(bare.startswith(f"{year}.{venue.lower()}") | bare.startswith(f"{year}-{venue.lower()}"))
    return hit.groupBy("page_id").agg(F.min_by("href", "pos").alias("proceedings_url"))


def cvf_listing(links: DataFrame, near: int = 7) -> DataFrame:
    """Papers of a listing with the first PDF link among the next seven links."""
    following = Window.partitionBy("page_id").orderBy("pos").rowsBetween(1, near)
    pdf = F.when(F.lower("href").endswith(".pdf") | F.lower("link_text").contains("pdf"), F.col("href"))
    rows = links.withColumn("pdf_url", F.first(pdf, ignorenulls=True).over(following))
    return rows.where(is_cvf_paper(F.col("href"))).select("page_id", "pos", F.col("link_text").alias("title"), F.col("href").alias("landing_url"), "pdf_url")


def pmlr_listing(links: DataFrame) -> DataFrame:
    return links.where(is_pmlr_paper(F.col("href"))).select("page_id", "pos", F.col("link_text").alias("title"), F.col("href").alias("landing_url"))


def pmlr_volume(links: DataFrame, venue: str, year: int) -> DataFrame:
    """The first link of each page that names venue and year and leads to a volume."""
    both = F.lower(F.concat_ws(" ", "link_text", "href"))
    hit = links.where(both.contains(venue.lower()) & both.contains(str(year)) & F.col("href").contains("/v"))
    return hit.groupBy("page_id").agg(F.min_by("href", "pos").alias("volume_url"))
