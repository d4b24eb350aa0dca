"""Questions about the library: chapters, durations, catalog, run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.formats import chapter_file_name


def complete_chapters(pages: DataFrame, audio: DataFrame) -> DataFrame:
    """(book_id, chapter, pages): chapters of which every page has audio. ``audio`` has (book_id, page_no)."""
    done = audio.select("book_id", "page_no").distinct().withColumn("__done", F.lit(True))
    return pages.join(done, ["book_id", "page_no"], "left").groupBy("book_id", "chapter").agg(F.count(F.lit(1)).alias("pages"), F.bool_and(F.col("__done").isNotNull()).alias("ok")).where("ok").drop("ok")


def chapter_durations(pages: DataFrame, audio: DataFrame) -> DataFrame:
    """(book_id, chapter, duration_ms) over pages with audio."""
    return pages.join(audio.select("book_id", "page_no", "duration_ms"), ["book_id", "page_no"]).groupBy("book_id", "chapter").agg(F.sum("duration_ms").alias("duration_ms"))


def catalog(files: DataFrame, chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapter files (book_id, variant, chapter, name, size) with title (else the file's stem) and duration (else 0). Books without files do not appear."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    joined = files.join(chapters.select("book_id", "chapter", "title"), ["book_id", "chapter"], "left").join(durations, ["book_id", "chapter"], "left")
    return joined.select("book_id", "variant", "chapter", F.coalesce("title", stem).alias("title"), "name", "size", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))


def variant_totals(entries: DataFrame) -> DataFrame:
    """(book_id, variant, chapters, size, duration_ms) and whether the variant is the book's first by name."""
    totals = entries.groupBy("book_id", "variant").agg(F.count(F.lit(1)).alias("chapters"), F.sum("size").alias("size"), F.sum("duration_ms").alias("duration_ms"))
    return totals.withColumn("is_first", F.row_number().over(Window.partitionBy("book_id").orderBy("variant")) == 1)


def chapter_manifest(pages: DataFrame, audio: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter, file_name, files): the page files, in order, that a complete chapter is made of."""
    ready = complete_chapters(pages, audio).select("book_id", "chapter")
    members = pages.join(ready, ["book_id", "chapter"], "left_semi").join(audio.select("book_id", "page_no", "file"), ["book_id", "page_no"])
    listed = members.groupBy("book_id", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "file"))), lambda x: x["file"]).alias("files"))
    return listed.join(chapters.select("book_id", "chapter", "title"), ["book_id", "chapter"]).select("book_id", "chapter", chapter_file_name(F.col("chapter") + 1, F.col("title")).alias("file_name"), "files")


def playlist(manifest: DataFrame) -> DataFrame:
    """(book_id, playlist): the list file's text, a header line and the chapter files in order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "file_name"))), lambda x: F.concat(x["file_name"], F.lit("\n")))
    return manifest.groupBy("book_id").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(names, "")).alias("playlist"))


def needs_archive(files: DataFrame, archives: DataFrame) -> DataFrame:
    """(book_id, variant) whose archive is missing or older than its newest file; files have mtime, archives built_at."""
    newest = files.groupBy("book_id", "variant").agg(F.max("mtime").alias("newest"))
    return newest.join(archives, ["book_id", "variant"], "left").where(F.col("built_at").isNull() | (F.col("built_at") < F.col("newest"))).select("book_id", "variant")


def run_summary(outcome: DataFrame) -> DataFrame:
    """One row per book of page outcomes (book_id, page_no, state, duration_ms, error), state skipped, produced or failed.

    Failures carry the first 200 characters of their error; the first five pages are listed.
    """
    state = lambda s: F.count_if(F.col("state") == s)
    # ranked before they are gathered: Spark limits the ranks ahead of the shuffle, so no row holds more than five
    first = Window.partitionBy("book_id").orderBy("page_no", "error")
    failed = outcome.where("state = 'failed'").select("book_id", "page_no", F.left("error", F.lit(200)).alias("error")).withColumn("r", F.row_number().over(first)).where("r <= 5")
    failures = failed.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "error"))).alias("first_failures"))
    sums = outcome.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("selected"), state("skipped").alias("skipped"), state("produced").alias("produced"), state("failed").alias("failed"),
        F.bround(F.coalesce(F.sum(F.when(F.col("state") == "produced", F.col("duration_ms"))), F.lit(0)) / 1000, 1).alias("audio_s"),
    )
    none = F.array().cast(failures.schema["first_failures"].dataType)
    return sums.join(failures, "book_id", "left").withColumn("first_failures", F.coalesce("first_failures", none))


def real_time_factor(trials: DataFrame) -> DataFrame:
    """(engine, audio_s, generation_s, factor) of trial rows."""
    sums = trials.groupBy("engine").agg(F.sum("audio_s").alias("audio_s"), F.sum("generation_s").alias("generation_s"))
    return sums.withColumn("factor", F.when(F.col("generation_s") > 0, F.col("audio_s") / F.col("generation_s")))


def change_signature(entries: DataFrame) -> DataFrame:
    """(book_id, signature) of directory entries (book_id, name, mtime): equal for equal multisets of entries, whatever their order.

    Entries are hashed one by one and the hashes added up, in two lanes of 60 bits, so partial sums of any partitioning merge and
    nothing is gathered. Adding or removing one entry changes a signature by that entry's hash.
    """
    mark = F.md5(F.concat_ws("|", F.length("name").cast("string"), "name", F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")).cast("string"), F.lit("-"))))
    lane = lambda first: F.sum(F.conv(F.substring(mark, first, 15), 16, 10).cast("decimal(38,0)"))
    return entries.groupBy("book_id").agg(F.concat_ws("-", F.count(F.lit(1)), lane(1).cast("string"), lane(16).cast("string")).alias("signature"))


def changed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book_id, name, change) between two listings (book_id, name, mtime) with one row a name: added, removed or changed.

    Only books whose signatures differ are compared entry by entry.
    """
    old, new = change_signature(before), change_signature(after)
    moved = old.join(new.withColumnRenamed("signature", "now"), "book_id", "full").where(~F.col("signature").eqNullSafe(F.col("now"))).select("book_id")
    held = before.join(moved, "book_id", "left_semi").select("book_id", "name", F.struct("mtime").alias("a"))
    found = held.join(after.join(moved, "book_id", "left_semi").select("book_id", "name", F.struct("mtime").alias("b")), ["book_id", "name"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.mtime").eqNullSafe(F.col("b.mtime")), "changed")
    return found.select("book_id", "name", change.alias("change")).where("change is not null")


def summary_line(summary: DataFrame) -> DataFrame:
    """``run_summary`` as one JSON text a book, with ``ok`` false if a page failed."""
    fields = ["book_id", "selected", "skipped", "produced", "failed", "audio_s", "first_failures"]
    return summary.select("book_id", F.to_json(F.struct(*fields)).alias("line"), (F.col("failed") == 0).alias("ok"))


def newest_first(books: DataFrame) -> DataFrame:
    """Books by time, the newest first; equal times by id."""
    return books.orderBy(F.col("mtime").desc_nulls_last(), "book_id")
