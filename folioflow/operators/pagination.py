"""Sentences to pages.

Sequential state ends with a book, so books are the unit of parallel work: rows are dealt by book, sorted within
their partitions, and folded as they stream by. A task holds one batch of rows and the fill of one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = 1500


def _numbered(target: int):
    """Batches sorted by book and chapter, their last columns size and heading, to the same rows with page_no in place of these two.

    A new page begins with a chapter, if the target would be passed, or before a heading on a page more than 0.6 full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, chapter, page, used, begun = None, None, 0, 0, False
        for batch in batches:
            books, chapters, sizes, heads = (batch.column(k).to_pylist() for k in (0, 1, -2, -1))
            out = np.empty(batch.num_rows, np.int32)
            for k, (b, c, n, head) in enumerate(zip(books, chapters, sizes, heads)):
                if not begun or b != book:
                    book, chapter, page, used, begun = b, c, 1, 0, True
                elif c != chapter:
                    chapter, page, used = c, page + 1, 0
                elif used and (used + n > target or head and used > target * 0.6):
                    page, used = page + 1, 0
                out[k] = page
                used += n + 1
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out)], names=[*names[:-2], "page_no"])

    return run


def greedy_pages(sentences: DataFrame, target: int = TARGET, size: Column | None = None) -> DataFrame:
    """``sentences`` (book_id, chapter, block_no, sent_no, gap, ...) with page_no, from 1 through the whole book.

    ``size`` is a sentence's length, that of the column ``sentence`` if not given; callers that need no text leave it out of the rows.
    """
    order = ["book_id", "chapter", "block_no", "sent_no"]
    others = [F.col(f"`{c}`") for c in sentences.columns if c not in (*order, "page_no")]
    sized = sentences.select(*order, *others, (F.length("sentence") if size is None else size).cast("int").alias("__size"), (F.col("gap") == "heading").alias("__heading"))
    shape = sized.drop("__size", "__heading").withColumn("page_no", F.lit(0)).schema
    return sized.repartition("book_id").sortWithinPartitions(*order).mapInArrow(_numbered(target), shape)


def physical_pages(sentences: DataFrame) -> DataFrame:
    """``sentences`` with page_no: runs of equal (chapter, source_page) in reading order."""
    order = Window.partitionBy("book_id").orderBy("block_no", "sent_no")
    changed = ~F.col("chapter").eqNullSafe(F.lag("chapter").over(order)) | ~F.col("source_page").eqNullSafe(F.lag("source_page").over(order)) | (F.row_number().over(order) == 1)
    return sentences.withColumn("page_no", F.sum(changed.cast("int")).over(order).cast("int"))


def sentence_offsets(paged: DataFrame, size: Column | None = None) -> DataFrame:
    """``paged`` with start and end of each sentence in its page's text; a paragraph or heading is followed by two characters, a sentence by one.

    ``size`` as in ``greedy_pages``.
    """
    n = F.length("sentence") if size is None else size
    page = Window.partitionBy("book_id", "page_no").orderBy("block_no", "sent_no")
    step = n + F.when(F.col("gap").isin("paragraph", "heading"), 2).otherwise(1)
    start = F.coalesce(F.sum(step).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return paged.withColumn("start", start).withColumn("end", (F.col("start") + n).cast("int"))


def page_texts(paged: DataFrame) -> DataFrame:
    """(book_id, page_no, chapter, text, sentences) of pages; the separator follows from the sentence before it."""
    rows = F.array_sort(F.collect_list(F.struct("block_no", "sent_no", "sentence", "gap", "start", "end")))
    grouped = sentence_offsets(paged).groupBy("book_id", "page_no").agg(F.min("chapter").alias("chapter"), rows.alias("r"))
    last = F.size("r") - 1
    parts = F.transform("r", lambda x, i: F.concat(x["sentence"], F.when(i == last, "").when(x["gap"] == "sentence", " ").otherwise("\n\n")))
    return grouped.select("book_id", "page_no", "chapter", F.array_join(parts, "").alias("text"), F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["gap"].alias("gap"))).alias("sentences"))


def _texts_of(page: pa.RecordBatch) -> pa.RecordBatch:
    """Whole pages of sentences (book_id, chapter, block_no, sent_no, gap, sentence, page_no) in order, one row a page."""
    gap, sentence = page.column("gap"), page.column("sentence")
    first = np.append(_page_starts(page), page.num_rows)
    size = pc.utf8_length(sentence).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = pc.is_in(gap, pa.array(["paragraph", "heading"])).to_numpy(zero_copy_only=False)
    step = size + 1 + wide
    start = np.cumsum(step) - step
    start -= np.repeat(start[first[:-1]], np.diff(first))
    mark = np.where(pc.equal(gap, "sentence").to_numpy(zero_copy_only=False), " ", "\n\n").astype(object)
    mark[first[1:] - 1] = ""
    bounds = pa.array(first, pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(bounds, pc.binary_join_element_wise(sentence, pa.array(mark, sentence.type), pa.scalar("", sentence.type))), pa.scalar("", sentence.type))
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(start + size, pa.int32()), gap], names=["start", "end", "gap"])
    at = pa.array(first[:-1])
    own = [page.column(c).take(at) for c in ("book_id", "page_no", "chapter")]
    return pa.RecordBatch.from_arrays([*own, text, pa.ListArray.from_arrays(bounds, spans)], names=["book_id", "page_no", "chapter", "text", "sentences"])


def _page_starts(rows: pa.RecordBatch) -> np.ndarray:
    book = rows.column("book_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
    page = rows.column("page_no").to_numpy()
    return np.flatnonzero(np.concatenate(([True], (book[1:] != book[:-1]) | (page[1:] != page[:-1]))))


def filled_pages(sentences: DataFrame, target: int = TARGET) -> DataFrame:
    """``page_texts`` of ``greedy_pages``, in the pass that numbers the pages: texts are dealt and sorted once, and a task holds a batch and one page."""
    order = ["book_id", "chapter", "block_no", "sent_no"]
    sized = sentences.select(*order, "gap", "sentence", F.length("sentence").cast("int").alias("__size"), (F.col("gap") == "heading").alias("__heading"))
    number = _numbered(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in number(batches):
            if not batch.num_rows:
                continue
            (rows,) = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
            last = int(_page_starts(rows)[-1])
            if last:
                yield _texts_of(rows.slice(0, last))
            held = [rows.slice(last)]
        for rows in held:
            yield _texts_of(rows)

    book, chapter = (f"{c} {sized.schema[c].dataType.simpleString()}" for c in ("book_id", "chapter"))
    return sized.repartition("book_id").sortWithinPartitions(*order).mapInArrow(run, f"{book}, page_no int, {chapter}, text string, sentences array<struct<start:int,end:int,gap:string>>")
