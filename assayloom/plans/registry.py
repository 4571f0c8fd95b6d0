"""Every query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayloom.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of ``Tables`` as the query ``name``, with the same result in DuckDB's SQL if it can be said there."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[name] = with_views(oracle)
        return f

    return register


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library sizes to log CPM to a moderated two-group test, for all studies at once."""
    return QUERIES["st_06_moderated_test"](spark, sf_dir)
