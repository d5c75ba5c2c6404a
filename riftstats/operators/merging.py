"""Rows over rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """One row a key: the newest, of equally new ones that with the largest values."""
    values = [c for c in rows.columns if c not in keys and c != newest]
    if not values and not newest:
        return rows.distinct()
    order = Window.partitionBy(*keys).orderBy(*([F.desc(newest)] if newest else []), *[F.desc(c) for c in values])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Incoming rows over current ones, of several incoming rows of a key the one
    with the highest `newest`; `change` tells inserted, updated, same. Keys may be
    null, which is a value of its own."""
    incoming = last_of_each(incoming, keys, newest)
    values = [c for c in incoming.columns if c not in keys]
    now, then = (F.struct(*[f"{side}.{c}" for c in values]) for side in "nc")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = current.withColumn("_c", F.lit(1)).alias("c").join(incoming.withColumn("_n", F.lit(1)).alias("n"), on, "full")
    same = now.eqNullSafe(then) if values else F.lit(True)
    change = F.when(F.col("_c").isNull(), "inserted").when(F.col("_n").isNull(), "kept").when(same, "same").otherwise("updated")
    return joined.select(*[F.when(F.col("_n").isNull(), F.col(f"c.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in (*keys, *values)], change.alias("change"))
