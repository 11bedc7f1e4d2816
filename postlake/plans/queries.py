"""Registered queries: what runs on the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.plans import bridge
from postlake.plans.bridge import AS_OF, AS_OF_TS, view, with_views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, *views: str, oracle: str | None = None):
    """Register a query with its oracle; ``views`` are put in front of the oracle text."""

    def put(run: Run) -> Run:
        REGISTRY[name] = Query(lambda s, d: plain(run(s, d)), with_views(oracle, *views) if oracle else None)
        return run

    return put


def plain(df: DataFrame) -> DataFrame:
    """Dates, times and arrays as text, so both engines return the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def load_all() -> dict[str, Query]:
    from postlake.plans import (  # noqa: F401
        queries_documents, queries_requests, queries_search, queries_store, queries_streams,
    )

    return REGISTRY


__all__ = ["AS_OF", "AS_OF_TS", "REGISTRY", "Query", "bridge", "load_all", "plain", "register", "view"]
