"""Metadata filters in JSON, compiled to predicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Lookup = Callable[[str], Column]


def number(c: Column) -> Column:
    """The value as a double, null if it is no number; metadata are strings."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def compile_filter(spec: dict, lookup: Lookup) -> Column:
    """andAll, greaterThan and lessThan; what cannot be compared does not match."""
    (op, arg), *more = spec.items()
    if more:
        raise ValueError("one operator an object")
    if op == "andAll":
        return reduce(Column.__and__, (compile_filter(x, lookup) for x in arg), F.lit(True))
    if op in ("greaterThan", "lessThan"):
        value = number(lookup(arg["key"]))
        test = value > F.lit(float(arg["value"])) if op == "greaterThan" else value < F.lit(float(arg["value"]))
        return F.coalesce(test, F.lit(False))
    raise ValueError(f"unknown filter {op!r}")
