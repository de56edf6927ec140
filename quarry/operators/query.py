"""A bound query as one declarative DataFrame: filter, aggregate, sort, limit, project.

Nothing is scheduled by hand: Catalyst prunes the columns and pushes the filter into
the scan, aggregates partially before the exchange, and turns sort and limit into a
top-k per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.predicates import column, predicate
from ..plans.binder import Aggregate, Bound


def sort_column(name: str, desc: bool) -> Column:
    """NULL is the largest value: last ascending, first descending."""
    return column(name).desc_nulls_first() if desc else column(name).asc_nulls_last()


def build(df: DataFrame, q: Bound) -> DataFrame:
    """The result of `q` over the rows of `df`, whose schema it was bound to."""
    types = {f.name: f.dataType for f in q.schema.fields}
    if q.where is not None:
        df = df.filter(predicate(q.where, types))
    # Sources get positional names in between, so no alias can hide a column.
    sources = list(dict.fromkeys([*(o.source for o in q.outputs), *(k.source for k in q.order)]))
    inner = {x: f"c{i}" for i, x in enumerate(sources)}
    if q.grouped:
        df = _aggregate(df, q, inner)
    else:
        df = df.select(*[column(x).alias(inner[x]) for x in sources])
    if q.order:
        df = df.orderBy(*[sort_column(inner[k.source], k.desc) for k in q.order])
    if q.limit is not None:
        df = df.limit(min(q.limit, (1 << 31) - 1))
    return df.select(*[F.col(inner[o.source]).alias(o.name) for o in q.outputs])


def _aggregate(df: DataFrame, q: Bound, inner: dict) -> DataFrame:
    keys = [column(k).alias(f"k{i}") for i, k in enumerate(q.keys)]
    values = [aggregate(a).alias(inner[a]) for a in q.aggregates]
    if not values:
        grouped = df.select(*keys).distinct()
    else:
        grouped = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
    at = {k: f"k{i}" for i, k in enumerate(q.keys)}
    return grouped.select(*[F.col(name if isinstance(x, Aggregate) else at[x]).alias(name) for x, name in inner.items()])
