"""Row numbers within keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.names import free_names
from folioflow.store import materialize


def null_key(value: Column) -> Column:
    """A text key that is never null: null first, then values by the bytes of their text."""
    return F.coalesce(F.concat(F.lit("s"), value.cast("string")), F.lit("n"))


def sorted_runs(df: DataFrame, cut: list, order: list, run: str = "run", at: str = "at") -> DataFrame:
    """``df`` as sorted runs in the shared folder, with ``run`` and ``at`` (place in the run, from 0).

    Rows are dealt by ranges of the expressions ``cut`` and sorted by ``cut`` and ``order``, so a key of any
    size spreads over as many runs as it needs, and runs follow each other in order.
    """
    (place,) = free_names(df, "place")
    lines = materialize(df.repartitionByRange(*cut).sortWithinPartitions(*cut, *order).withColumn(place, F.monotonically_increasing_id()))
    # a row's number holds its partition above bit 33 and its place in it below
    return lines.withColumn(run, F.shiftright(place, 33).cast("int")).withColumn(at, F.col(place).bitwiseAND((1 << 33) - 1)).drop(place)


def numbered(df: DataFrame, key: str, order: list, pos: str = "pos", total: str = "n") -> DataFrame:
    """``df`` with ``pos`` (from 0, by ``order`` within ``key``) and ``total`` (rows of the key). ``key`` must not be null.

    Places are counted a run at a time and shifted by what the runs before hold of the key; the only
    window runs over one row for each pair of key and run. Rows that are equal in ``order`` get any of their places.
    """
    run, at, first, held, start = free_names(df, "run", "at", "first", "held", "start")
    lines = sorted_runs(df, [key, *order], [], run, at)
    counts = lines.groupBy(key, run).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(held))
    by = Window.partitionBy(key)
    before = F.coalesce(F.sum(held).over(by.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.withColumn(start, before).withColumn(total, F.sum(held).over(by)).drop(held)
    return lines.join(shifts, [key, run]).withColumn(pos, F.col(at) - F.col(first) + F.col(start)).drop(run, at, first, start)
