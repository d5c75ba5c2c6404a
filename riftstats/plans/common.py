"""What the registered queries share: rounding, and pieces of their oracles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import Tables, duckdb_with

#: A query over the projections and the DuckDB text that gives the same rows
#: (None where SQL doesn't express it).
Query = tuple[Callable[[Tables], DataFrame], str | None]

RANKED = "rr AS (SELECT p.match_id, p.participant_id, p.team_id, p.puuid, p.champion_id, p.team_position, p.win, p.kills, p.deaths, p.assists, m.patch, m.match_date, m.duration FROM participants p JOIN matches m ON p.match_id = m.match_id WHERE m.status = 1 AND (m.queue_id = 420 OR (m.queue_id = 0 AND m.queue_type = '420')) AND p.team_position <> '')"
SOLO = "solo AS (SELECT puuid, tier FROM ranks WHERE queue_type = 'RANKED_SOLO_5x5')"


def EFF(conf: int | str, avail: str, floor: int) -> str:  # noqa: N802
    return f"greatest(1, least({conf}, {avail}, greatest({floor}, ceil(0.15 * {avail}))))"


def GRADE(p: str) -> str:  # noqa: N802
    return f"CASE WHEN {p} < 0.1 THEN 'S' WHEN {p} < 0.3 THEN 'A' WHEN {p} < 0.6 THEN 'B' WHEN {p} < 0.85 THEN 'C' ELSE 'D' END"


def oracle(tables: tuple[str, ...], rest: str) -> str:
    """The projections as CTEs, then more CTEs and the final SELECT."""
    return f"{duckdb_with(*tables)},\n{rest}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines compare alike."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def folder(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share: the cluster's
    setting. Only a local session may do without it."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once for what reads them several times."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
