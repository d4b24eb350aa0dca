"""Parsed books, kept by content id and parser version; derived audio goes when its book is parsed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.speech import is_speakable, spoken_form
from folioflow.sources.files import uncached
from folioflow.sources.versions import Versions
from folioflow.store import materialize

TABLES = {
    "books": ("book_id string, parser_version int, source string, pages int, chars long", []),
    "pages": ("book_id string, page_no int, chapter int, text string, sentences array<struct<start:int,end:int,gap:string>>", ["page_no"]),
    "blank": ("book_id string, parser_version int", []),
    "audio": ("book_id string, variant string, page_no int, file string, duration_ms long", ["variant", "page_no"]),
}


def open_cache(spark: SparkSession, path: str, buckets: int = 32) -> Versions:
    return Versions(spark, path, "book_id", TABLES, buckets)


def parse_new(cache: Versions, files: DataFrame, parse: Callable[[DataFrame], DataFrame], parser_version: int) -> DataFrame:
    """Parse the ``files`` (book_id, source, ...) that this parser version has not seen, and return their book_id.

    ``parse`` makes pages (book_id, page_no, chapter, text, sentences) of files. Books, pages and the loss of audio
    become visible together. A file without pages is no book, and is kept as blank, so that this version does not parse it again; a book of an older version
    stays then. A book that an older version parsed loses its audio, as its pages may have moved.
    """
    seen = cache.read("books").select("book_id", "parser_version").union(cache.read("blank"))
    new = materialize(uncached(files.select("book_id", "source"), seen, parser_version).groupBy("book_id").agg(F.min("source").alias("source")))
    ids = new.select("book_id")
    if new.isEmpty():
        return ids
    pages = materialize(parse(files.join(new, ["book_id", "source"], "left_semi").dropDuplicates(["book_id"])).select("book_id", "page_no", "chapter", "text", "sentences"))
    totals = pages.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.sum(F.length("text")).cast("long").alias("chars"))
    books = materialize(new.join(totals, "book_id").select("book_id", F.lit(parser_version).alias("parser_version"), "source", "pages", "chars"))
    cache.replace(books.select("book_id"), drop=["audio"], books=books, pages=pages)
    blank = materialize(ids.join(books.select("book_id"), "book_id", "left_anti").select("book_id", F.lit(parser_version).alias("parser_version")))
    cache.replace(blank.select("book_id"), blank=blank)
    return ids


def add_audio(cache: Versions, made: DataFrame) -> int:
    """Add page audio (as table ``audio``) of cached books; rows of the same book, variant and page are replaced. Books and pages stay as they lie."""
    made = materialize(made.join(cache.read("books").select("book_id"), "book_id", "left_semi"))
    touched = made.select("book_id").distinct()
    old = cache.read("audio").join(touched, "book_id", "left_semi").join(made, ["book_id", "variant", "page_no"], "left_anti")
    return cache.replace(touched, audio=old.unionByName(made))


def spoken_sentences(pages: DataFrame, speak: Callable[[Column, Column], Column] = spoken_form) -> DataFrame:
    """``pages`` (text, sentences, ...) with one row for each sentence whose spoken form has something to speak: sent_no, sentence, spoken."""
    kept = [c for c in pages.columns if c not in ("text", "sentences")]
    each = pages.select(*kept, "text", F.posexplode("sentences").alias("sent_no", "s"))
    cut = each.withColumn("sentence", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    return cut.withColumn("spoken", speak(F.col("sentence"), F.col("s.gap") == "heading")).where(is_speakable(F.col("spoken"))).select(*kept, "sent_no", "sentence", "spoken")


def page_request(spec: DataFrame, col: str = "spec") -> DataFrame:
    """``spec`` with book_id and page_no of texts like ``<book>:<page>``; the last colon counts, and a missing or broken number gives null."""
    parts = F.split(col, ":")
    return spec.withColumn("book_id", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ":")).withColumn("page_no", F.element_at(parts, -1).try_cast("int"))
