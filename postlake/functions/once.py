"""Evaluate an expression once and use its value many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read but do not compute again.

    The optimizer moves filters below projections by repeating their expressions. It does not
    move them below a generator, so a costly parse becomes a generator of one row.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(value)).alias(name))
