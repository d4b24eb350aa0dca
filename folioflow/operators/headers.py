"""Running headers, footers and page numbers of extracted page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.cleaning import header_key, is_page_number


def edge_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (book_id, page_no, line_no, text) with edge: 1, 2, -2, -1 among a page's non-blank lines, else null.

    Only pages with more than two non-blank lines have edges; on three lines the middle
    one counts from the end.
    """
    filled = F.when(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(1))
    page = Window.partitionBy("book_id", "page_no")
    numbered = lines.withColumn("__first", F.sum(filled).over(page.orderBy("line_no"))).withColumn("__all", F.sum(filled).over(page))
    up, down = F.col("__first"), F.col("__all") - F.col("__first") + 1
    edge = F.when(filled.isNull() | (F.col("__all") <= 2), None).when(down <= 2, -down).when(up <= 2, up).cast("int")
    return numbered.withColumn("edge", edge).drop("__first", "__all")


def repeated_keys(edges: DataFrame, share: float = 0.3, least: int = 3, pages: DataFrame | None = None) -> DataFrame:
    """(book_id, edge, key) on at least max(least, floor(share * pages)) pages of the book.

    ``pages`` (book_id, page_no) lists all pages, those without a line included; else the pages of ``edges`` count.
    """
    keyed = edges.where("edge is not null").select("book_id", "page_no", "edge", header_key(F.col("text")).alias("key")).where("key <> ''")
    counts = keyed.groupBy("book_id", "edge", "key").agg(F.count(F.lit(1)).alias("n"))
    all_pages = (edges if pages is None else pages).select("book_id", "page_no").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(all_pages, "book_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("book_id", "edge", "key")


def drop_headers(lines: DataFrame, share: float = 0.3, least: int = 3, pages: DataFrame | None = None) -> DataFrame:
    """``lines`` without repeated edge lines and bare page numbers at page edges; ``pages`` as in ``repeated_keys``."""
    edges = edge_lines(lines).withColumn("key", header_key(F.col("text")))
    hits = repeated_keys(edges.drop("key"), share, least, pages).withColumn("__hit", F.lit(True))
    marked = edges.join(hits, ["book_id", "edge", "key"], "left")
    gone = F.col("edge").isNotNull() & (F.col("__hit").isNotNull() | is_page_number(F.col("text")))
    return marked.where(~gone).select(*lines.columns)
