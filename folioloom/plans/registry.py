"""Queries by name, with their oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioloom.plans import arrivals, corpus, details, flow, maintenance, more, search, vectors
from folioloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _shipped(run: Query) -> Query:
    """The query, after the executors have this package for its Python functions."""

    @functools.wraps(run)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return call


for _module in (search, corpus, maintenance, details, flow, more, vectors, arrivals):
    for _name, _run, _sql in _module.ALL:
        QUERIES[_name] = _shipped(_run)
        if _sql is not None:
            ORACLE_SQL[_name] = _sql
