"""All registered queries over the driver's tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import NEEDS, Tables
from . import analytics, landing, people, streams

ALL = analytics.QUERIES | people.QUERIES | landing.QUERIES | streams.QUERIES


def queries(landed: str | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries; with `landed` they read a star schema that land() has written."""
    return {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir, landed)) for name, (f, _) in ALL.items()}


def land(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the star schema, each table from those that it needs."""
    for name in NEEDS:
        getattr(Tables(spark, sf_dir, folder, without=name), name).write.mode("overwrite").parquet(f"{folder}/{name}")


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
