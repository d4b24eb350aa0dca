"""Blocks to sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.binding import let
from folioflow.functions.sentences import split_sentences

GAPS = ("sentence", "paragraph", "heading")


def sentences(blocks: DataFrame) -> DataFrame:
    """Sentences of blocks (text, is_heading, ...): sent_no from 0, sentence, gap; other columns but the text repeat.

    A heading is one sentence however long. The gap after a sentence is ``heading``,
    ``paragraph`` (the last of its block) or ``sentence``. Rows stay where they are: no shuffle.
    """
    heading = F.coalesce("is_heading", F.lit(False))
    parts = F.when(heading, F.array("text")).otherwise(split_sentences(F.col("text")))
    marked = let(parts, lambda p: F.transform(p, lambda s, i: F.struct(s.alias("sentence"), (i == F.size(p) - 1).alias("last"))))
    kept = [F.col(f"`{c}`") for c in blocks.columns if c not in ("text", "sent_no", "sentence", "gap")]
    # an outer explode, as the size filter that Spark adds to the inner one would evaluate the split again
    out = blocks.select(*kept, heading.alias("__h"), F.posexplode_outer(marked).alias("sent_no", "s")).where("s is not null")
    gap = F.when(F.col("__h"), "heading").when(F.col("s.last"), "paragraph").otherwise("sentence")
    return out.withColumn("sentence", F.col("s.sentence")).withColumn("gap", gap).drop("__h", "s")


def source_page(bounds: Column, at: Column) -> Column:
    """As-of lookup: page of the last bound (pos, page) at or before ``at``; before the first bound, the first."""
    reached = F.filter(bounds, lambda b: b["pos"] <= at)
    return F.when(F.size(bounds) > 0, F.coalesce(F.get(reached, F.size(reached) - 1), F.get(bounds, F.lit(0)))["page"])
