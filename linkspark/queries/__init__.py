"""Queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from linkspark.queries import base, basic, resolution, serving, stages, vectors  # noqa: F401  they register themselves

    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from linkspark.queries import base

    return dict(base.SQL)
