"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker: with whole documents the
#: default of 10,000 would make the memory of a task grow with document length.
ARROW_ROWS = 256
#: Rows of a few numbers or one digest that are sent to every executor at most;
#: beyond it such a table is joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until no column of df is called so."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch size, which Spark reads when a plan runs, so it
    can't be put back here; later queries get smaller batches, not other results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is the cluster's setting;
    a local one is made only for a local session without it (tests)."""
    got = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        got = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table of its own to the shared folder and read from there:
    for results that are read several times and need columns and compression."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table for a join: written out and counted, and marked for
    broadcasting if it has at most `rows` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def join_by_key(rows: DataFrame, side: DataFrame, key: str, n: str, how: str = "inner", sent: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined to a narrow table with one row a key and the number `n` of rows that
    have it (left out of the result). The `sent` most frequent keys are sent out, so
    that none of them is one task's; the others, of which each is rare then, meet
    their rows by a shuffle."""
    if side.count() <= sent:
        return rows.join(F.broadcast(side.drop(n)), key, how)
    often = F.broadcast(cut(side.orderBy(F.desc(n), key).limit(sent)).drop(n))
    rest = rows.join(often.select(key), key, "left_anti").join(side.drop(n), key, how)
    return rows.join(often, key).unionByName(rest)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)
