"""Row scopes: which matches and participants an analysis looks at."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SUCCESS, ranked_solo, tier_scope, visible


def shared(df: DataFrame) -> DataFrame:
    """df, written once to the folder that driver and executors share if the session
    names one (spark.checkpoint.dir), so that a plan that reads it several times
    doesn't compute it again; df itself otherwise, with a warning."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not (folder := spark.conf.get("spark.checkpoint.dir", "")):
            warnings.warn("spark.checkpoint.dir isn't set: shared inputs are computed several times", stacklevel=2)
            return df
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def visible_matches(matches: DataFrame) -> DataFrame:
    return matches.where(visible())


def solo_ranks(ranks: DataFrame) -> DataFrame:
    """(puuid, tier): one solo rank a player."""
    return ranks.where(F.col("queue_type") == "RANKED_SOLO_5x5").select("puuid", "tier")


def ranked_rows(matches: DataFrame, participants: DataFrame, patch: str | None = None, role: str | None = None) -> DataFrame:
    """Participants with a position in ranked solo matches that were fetched."""
    own = matches.where((F.col("status") == SUCCESS) & ranked_solo())
    if patch is not None:
        own = own.where(F.col("patch") == patch)
    rows = participants.where(F.col("team_position").isNotNull() & (F.col("team_position") != ""))
    if role and role.upper() != "ALL":
        rows = rows.where(F.col("team_position") == role.upper())
    return rows.join(own.select("match_id", "patch", "match_date", "duration"), "match_id")


def in_region(rows: DataFrame, summoners: DataFrame | None, region: str | None) -> DataFrame:
    """Rows of players of a region or platform (either is accepted); all if none
    is named."""
    name = (region or "").strip().upper()
    if name in ("", "ALL"):
        return rows
    return rows.join(summoners.where((F.upper("region") == name) | (F.upper("platform_region") == name)).select("puuid").distinct(), "puuid", "left_semi")


def in_tiers(rows: DataFrame, ranks: DataFrame | None, scope: str | None) -> DataFrame:
    """Rows of players whose solo rank is in the scope; all if it names none."""
    tiers = tier_scope(scope)
    if tiers is None:
        return rows
    return rows.join(solo_ranks(ranks).where(F.col("tier").isin(tiers)).select("puuid"), "puuid", "left_semi")


def marked_tiers(rows: DataFrame, ranks: DataFrame | None, scope: str | None, out: str) -> DataFrame:
    """All rows, with whether the player's solo rank is in the scope."""
    tiers = tier_scope(scope)
    if tiers is None:
        return rows.withColumn(out, F.lit(True))
    own = solo_ranks(ranks).where(F.col("tier").isin(tiers)).select("puuid", F.lit(True).alias(out))
    return rows.join(own, "puuid", "left").withColumn(out, F.coalesce(out, F.lit(False)))
