"""Query registry: query key -> Spark plan builder, plus its DuckDB oracle text.

A plan builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The
oracle (when the operator is SQL-expressible) is an independent statement of
the same result that DuckDB runs on the same parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PlanFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, PlanFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(key: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: PlanFn) -> PlanFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        if headline:
            HEADLINE.append(key)
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import (ingest, analytics, monitor, features, modeling, learning, streams)  # noqa: F401
