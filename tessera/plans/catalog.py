"""Registry of named queries: a Spark builder plus, where the operator can be
written in SQL, an independent DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    headline: bool


_REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, headline: bool = False):
    def wrap(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, oracle, headline)
        return fn
    return wrap


def all_queries() -> dict[str, Query]:
    # Importing the modules fills the registry.
    from . import (q_clean, q_quality, q_drift, q_features,  # noqa: F401
                   q_files, q_metrics, q_models, q_sketch, q_stream, q_trees)
    return dict(_REGISTRY)
