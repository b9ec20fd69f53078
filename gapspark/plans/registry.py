"""The table of registered queries and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gapspark.plans.fixtures import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Views(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a function of the views; ``sql`` says the same as SQL text."""

    def register(build: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, build, with_views(views, sql) if sql else None)
        return build

    return register


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from gapspark.plans import (  # noqa: F401
        catalog_queries, ingest_queries, lifecycle_queries, merge_queries, review_queries,
        streaming_queries, text_queries,
    )

    return REGISTRY
