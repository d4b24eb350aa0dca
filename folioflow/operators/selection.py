"""Which pages to produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected_pages(expression: Column, last: Column) -> Column:
    """Sorted distinct page numbers within [1, last] of an expression like ``1-20,35``; empty means all. A range that runs backwards is empty, ``5-`` is 5."""
    last = last.cast("int")

    def pages(part: Column) -> Column:
        first = F.trim(F.substring_index(part, "-", 1)).cast("int")
        end = F.trim(F.substring(part, F.instr(part, "-") + 1, F.length(part)))
        upto = F.when((F.instr(part, "-") > 0) & (end != ""), end.cast("int")).otherwise(first)
        low, high = F.greatest(first, F.lit(1)), F.least(upto, last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(expression, ","), pages))))
    everything = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(expression, F.lit("")) == "", everything).otherwise(chosen)


def still_to_produce(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(done.select(*keys), keys, "left_anti")


def selected_rows(pages: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose keys are selected; a page comes once however often it is selected."""
    return pages.join(selection.select(*keys), keys, "left_semi")
