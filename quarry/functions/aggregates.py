"""Bound aggregates as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.binder import Aggregate
from .predicates import column


def aggregate(a: Aggregate) -> Column:
    """NULLs are skipped except by COUNT(*); integer sums are bigint and fail on overflow under ANSI."""
    if a.column is None:
        return F.count(F.lit(1))
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](column(a.column))
