"""Registry of named queries, each with the SQL an independent engine answers it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from leeward.sources.fixtures import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


_QUERIES: dict[str, Query] = {}
_MODULES = ("sensor_queries", "registry_queries", "weather_queries", "exposure_queries", "validation_queries", "landing_queries",
            "governance_queries", "audit_queries", "stream_queries")


def query(sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, build, sql)
        return build
    return register


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"leeward.plans.{module}")
    return dict(_QUERIES)


def q6(expression: str) -> str:
    """SQL text of the six-digit quantization that ``functions.numeric.quantize`` does."""
    return f"floor(({expression}) * 1000000 + 0.5) / 1000000"


def q3(expression: str) -> str:
    """Three digits, for deposits: engines differ in the last bits of sines and exponentials."""
    return f"floor(({expression}) * 1000 + 0.5) / 1000"
