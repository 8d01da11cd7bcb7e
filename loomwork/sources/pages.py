"""HTML pages as rows: text, title and links, as nested regular expressions; and a stricter tokenizer as an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import extract
from loomwork.session import checkpointed
from loomwork.sources.pdf import pdf_lines

SILENT = ("script", "style", "noscript", "svg")
#: Longest text that is stored of a crawled page; uploaded files are read whole.
STORED = 200_000


def html_text(html: Column) -> Column:
    """Text of a page, one node a line: silent elements and comments go, tags end lines, blank lines go."""
    out = F.regexp_replace(html, "(?is)<!--.*?-->", " ")
    for tag in SILENT:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    out = F.regexp_replace(out, "(?s)<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(out, r"[\r\n]+"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")
    return F.array_join(lines, "\n")


def html_title(html: Column) -> Column:
    title = F.nullif(F.trim(extract(html, "(?is)<title[^>]*>(.*?)</title>")), F.lit(""))
    heading = F.trim(F.regexp_replace(extract(html, "(?is)<h1[^>]*>(.*?)</h1>"), "(?s)<[^>]*>", ""))
    return F.coalesce(title, F.nullif(heading, F.lit("")))


def raw_links(html: Column) -> Column:
    """Absolute http(s) targets of anchors, without fragments, each once and sorted."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["'](https?://[^"'#\s]+)"""), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def same_host_links(url: Column, html: Column) -> Column:
    own = F.try_parse_url(url, F.lit("HOST"))
    return F.filter(raw_links(html), lambda x: F.coalesce(F.try_parse_url(x, F.lit("HOST")) == own, F.lit(False)))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.silent, self.lines, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.lines += [x for x in map(str.strip, data.splitlines()) if x]


def resolved_links(pages: DataFrame) -> DataFrame:
    """pages(url, html) with links: relative targets are resolved too, same host only. An Arrow function, as no built-in resolves."""

    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for urls, pages in parts:
            out = []
            for url, html in zip(urls, pages, strict=True):
                reader = _Reader()
                reader.feed(html or "")
                found = {urljoin(url, x).split("#")[0] for x in reader.links}
                out.append(sorted(x for x in found if urlsplit(x).scheme in ("http", "https") and urlsplit(x).netloc == urlsplit(url).netloc))
            yield pd.Series(out, dtype=object)

    return pages.withColumn("links", F.pandas_udf(read, "array<string>")("url", "html"))


def crawl(pages: DataFrame, seeds: DataFrame, most_depth: int, most_pages: int = 80) -> DataFrame:
    """(url, depth): what a breadth-first walk over same-host links reaches, most_pages of a host at most.

    pages(url, html) is the web; each round joins the frontier to its links and takes away what was visited.
    """
    links = pages.select("url", F.explode(same_host_links(F.col("url"), F.col("html"))).alias("next"))
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, most_depth + 1):
        front = seen.where(F.col("depth") == depth - 1)
        found = front.join(links, "url").select(F.col("next").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = checkpointed(seen.unionByName(found.join(pages.select("url"), "url", "left_semi").withColumn("depth", F.lit(depth))))
    host = F.try_parse_url("url", F.lit("HOST"))
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy(host).orderBy("depth", "url"))).where(F.col("_n") <= most_pages).drop("_n")


def stored(pages: DataFrame) -> DataFrame:
    """Rows of raw documents: title, text up to the stored length, and its hash."""
    return pages.withColumns({"title": html_title(F.col("html")), "raw_text": F.substring(html_text(F.col("html")), 1, STORED)}).withColumn(
        "content_hash", F.sha2("raw_text", 256)
    )


def uploads(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """HTML, text and PDF files of a folder as pages; other kinds, unreadable files, and larger files if there is a limit, are passed on with a null text and a problem."""
    return read_files(spark.read.format("binaryFile").load(path), most_bytes)


def read_files(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """files(path, length, content) -> url, kind, html, raw_text (all of it), problem."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    fits = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    body = F.when(fits & kind.isin("html", "htm", "txt"), F.try_validate_utf8(F.col("content").cast("string")))
    own = F.when(fits & (kind == "pdf"), F.col("content"))  # only these bytes go to Python
    out = files.select(F.concat(F.lit("manual://"), F.regexp_extract("path", r"([^/]+)$", 1)).alias("url"), kind.alias("kind"), body.alias("html"), pdf_lines(own).alias("_pdf"))
    text = F.when(F.col("kind") == "pdf", F.col("_pdf")).when(F.col("kind") == "txt", F.col("html")).otherwise(html_text(F.col("html")))
    out = out.withColumn("raw_text", text).drop("_pdf")
    return out.withColumn("problem", F.when(F.length("raw_text") < 20, "too little text").when(F.col("raw_text").isNull(), "unreadable"))
