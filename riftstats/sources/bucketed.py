"""The match tables in buckets of match_id, so that their joins need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that meet by match_id.
BY_MATCH = ("matches", "participants", "bans", "items", "runes", "frames")


def bucket_name(database: str, name: str) -> str:
    return f"{database}.{name}_by_match"


def write_buckets(df: DataFrame, database: str, name: str, buckets: int, patches: DataFrame | None = None) -> None:
    """Saves a table in buckets of match_id, sorted by it, inside folders of patches
    (of the matches' own `patch`, or of patches: match_id, patch). Rows are dealt to
    the buckets first, so that a task writes one file a patch."""
    if patches is not None and "patch" not in df.columns:
        df = df.join(patches.select("match_id", "patch"), "match_id")
    dealt = df.repartition(buckets, F.col("match_id")).sortWithinPartitions("patch", "match_id")
    dealt.write.mode("overwrite").format("parquet").partitionBy("patch").bucketBy(buckets, "match_id").sortBy("match_id").saveAsTable(bucket_name(database, name))


def by_match(spark: SparkSession, database: str, name: str) -> DataFrame:
    """A table as saved. Joins and groups by match_id and more columns keep its
    partitioning, for which the session must not ask for all keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    df = spark.table(bucket_name(database, name))
    return df.drop("patch") if name in ("participants", "bans", "items", "frames") else df
