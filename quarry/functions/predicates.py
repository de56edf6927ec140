"""Bound predicates as Spark columns with typed literals, so that they stay pushable.

NaN is the greatest fraction and not in the minima and maxima of row groups, by which a pushed
condition would drop it. Conditions on fractions therefore say outright what NaN gives, and only
the parts that NaN cannot satisfy, also when negated, are left for the scan.
"""

from __future__ import annotations

import math
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as s

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_MIRROR = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: object, kind: T.DataType | None = None) -> Column:
    if isinstance(value, datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S") + f".{value.microsecond:06d}"
        return F.expr(f"TIMESTAMP '{text}Z'" if isinstance(kind, T.TimestampType) else f"TIMESTAMP_NTZ '{text}'")
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long") if -(1 << 63) <= value < 1 << 63 else F.lit(float(value))
    return F.lit(value)


def _against(name: str, op: str, value: object, types: dict[str, T.DataType]) -> Column:
    kind, col = types[name], column(name)
    if isinstance(kind, T.DateType):
        col = col.cast("timestamp_ntz")
    if isinstance(value, float) and isinstance(kind, T.IntegralType) and op in ("<", "<=", ">", ">=") and math.isfinite(value):
        # A fraction against whole numbers: round it to the nearest bound that means the same.
        value, op = (math.floor(value), "<=") if op[0] == "<" else (math.ceil(value), ">=")
    found = _COMPARE[op](col, literal(value, kind))
    if value is None or not isinstance(kind, (T.FloatType, T.DoubleType)):
        return found
    return F.isnan(col) | found if op in (">", ">=", "<>") else ~F.isnan(col) & found


def predicate(x: s.Node, types: dict[str, T.DataType]) -> Column:
    """A condition with SQL's three values; a filter keeps the rows where it is true."""
    if isinstance(x, s.Binary):
        if x.op in ("AND", "OR"):
            a, b = predicate(x.left, types), predicate(x.right, types)
            return a & b if x.op == "AND" else a | b
        if isinstance(x.left, s.Column) and isinstance(x.right, s.Literal):
            return _against(x.left.name, x.op, x.right.value, types)
        if isinstance(x.left, s.Literal) and isinstance(x.right, s.Column):
            return _against(x.right.name, _MIRROR[x.op], x.left.value, types)
        sides = [column(v.name) if isinstance(v, s.Column) else literal(v.value) for v in (x.left, x.right)]
        return _COMPARE[x.op](*sides)
    if isinstance(x, s.Not):
        return ~predicate(x.x, types)
    if isinstance(x, s.IsNull):
        return column(x.x.name).isNotNull() if x.negated else column(x.x.name).isNull()
    if isinstance(x, s.InList):
        if any(isinstance(v.value, float) for v in x.items) and isinstance(types[x.x.name], T.IntegralType):
            found = reduce(lambda a, b: a | b, [_against(x.x.name, "=", v.value, types) for v in x.items])
        else:
            col = column(x.x.name).cast("timestamp_ntz") if isinstance(types[x.x.name], T.DateType) else column(x.x.name)
            found = col.isin(*[literal(v.value, types[x.x.name]) for v in x.items])
            if isinstance(types[x.x.name], (T.FloatType, T.DoubleType)) and not any(v.value is None for v in x.items):
                found = ~F.isnan(col) & found
        return ~found if x.negated else found
    if isinstance(x, s.Between):
        found = _against(x.x.name, ">=", x.low.value, types) & _against(x.x.name, "<=", x.high.value, types)
        if not x.negated and isinstance(types[x.x.name], (T.FloatType, T.DoubleType)):
            # The upper bound leaves NaN out, so the lower one can be pushed.
            found = found & (column(x.x.name) >= literal(x.low.value, types[x.x.name]))
        return ~found if x.negated else found
    if isinstance(x, s.Column):
        return column(x.name)
    return F.lit(x.value).cast("boolean")
