"""Broadcast behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else unchanged.

    ``df`` should be cheap to count (a materialised table): the count reads at most
    ``max_rows + 1`` of its rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
