"""All queries of the engine and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.plans import operator_queries
from netloom.plans.fixtures import tables, with_views
from netloom.plans.portable import PORTABLE, sql_for

flagship = operator_queries.flagship


def _portable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views, text = sql_for(name, "spark")
        # Counts over all boxes need no exchange by image.
        tables(spark, sf_dir, ("lineitem",) if "image_id" in text else ())
        return spark.sql(with_views(text, views, "spark"))

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _portable(name) for name in PORTABLE} | operator_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in PORTABLE:
        views, text = sql_for(name, "duckdb")
        found[name] = with_views(text, views, "duckdb")
    return found | operator_queries.ORACLES
