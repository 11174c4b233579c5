"""Listing pages to rows: tables, anchors with a context window, blocks between markers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schemas import once


def settled(rows: DataFrame) -> DataFrame:
    """The rows with every column computed here, once: filters and columns that name one several times do not compute it again."""
    return rows.select(once(F.struct(*rows.columns)).alias("_row")).select("_row.*")


def extract_table_rows(pages: DataFrame, raw: bool = False) -> DataFrame:
    """(page_id, row, cells): every table row with cells, the cells cleaned of tags unless ``raw``."""
    body = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr")
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    cells = cells if raw else F.transform(cells, lambda c: T.strip_tags(c))
    return settled(pages.select("page_id", body).select("page_id", "row", cells.alias("cells"))).where(F.size("cells") > 0)


def split_blocks(pages: DataFrame, marker: str) -> DataFrame:
    """(page_id, block, capture, body): the page cut at a marker with one group; what stands before the first marker is dropped."""
    captures = F.regexp_extract_all("html", F.lit(marker), F.lit(1))
    bodies = F.slice(F.split("html", marker, -1), F.lit(2), F.size(captures) + 1)
    pairs = F.arrays_zip(captures.alias("capture"), bodies.alias("body"))
    return pages.where(F.size(captures) > 0).select("page_id", F.posexplode(pairs).alias("block", "x")).select("page_id", "block", "x.capture", "x.body")


def extract_anchor_blocks(pages: DataFrame, href: str = r'[^"]*', before: int = 0, after: int = 2000) -> DataFrame:
    """(page_id, pos, href, title, context): matching anchors with a title and the characters around them.

    Match places are not to be had from SQL's regular expressions, so this is one Arrow pass over the pages; a page's
    HTML never leaves its task.
    """
    anchor = re.compile(rf'<a\b[^>]*href="({href})"[^>]*>(.*?)</a>', re.I | re.S)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, n, m[1], m[2], h[max(0, m.start() - before) : m.end() + after]) for i, h in zip(batch.page_id, batch.html, strict=True) if h for n, m in enumerate(anchor.finditer(h))]
            yield pd.DataFrame(out, columns=["page_id", "pos", "href", "title", "context"])

    found = pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, href string, title string, context string")
    return settled(found.withColumn("title", T.decode_entities(T.strip_tags(F.col("title"))))).where(F.col("title") != "")


def first_of_page(rows: DataFrame, item: str) -> DataFrame:
    """The first occurrence of an item on its page."""
    order = Window.partitionBy("page_id", item).orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
