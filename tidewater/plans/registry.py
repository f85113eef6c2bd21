"""Where queries are registered, each with the same query in DuckDB's SQL if SQL can tell it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share."""
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def _load() -> None:
    from . import answers, catalogue, jobs, landed, reports, runs, upkeep, values  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
