"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame (canonical types)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathweave.plans.context import Ctx
from pathweave.plans.output import canonical

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[[Ctx], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Ctx], DataFrame]):
        _REGISTRY[name] = fn
        return fn
    return deco


def _wrap(fn: Callable[[Ctx], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return canonical(fn(Ctx(spark, sf_dir)))
    run.__name__ = fn.__name__
    return run


def all_queries() -> dict[str, Query]:
    # import modules that register queries
    from pathweave.plans import q_tables, q_primitives, q_reports, q_catalog, q_streaming  # noqa: F401
    return {k: _wrap(v) for k, v in _REGISTRY.items()}
