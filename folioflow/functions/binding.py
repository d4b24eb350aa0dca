"""Bind a costly expression once: a lambda variable is evaluated a single time, a repeated Column at every mention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
