"""Work-lists: what to fetch, retry or refresh next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import PERMANENT_FAILURE, SUCCESS, TEMPORARY_FAILURE, ranked_solo
from .scope import visible_matches

MINUTE = 60_000


def patch_coverage(matches: DataFrame, participants: DataFrame, now_ms: int, target: int = 400, least: int = 30, most: int = 120, stale_hours: int = 24) -> DataFrame:
    """Fetched matches of each patch and how many to queue to reach the target."""
    own = visible_matches(matches).where(F.col("status") == SUCCESS)
    roles = participants.where("team_position is not null and team_position <> ''").select("match_id").distinct().withColumn("has_role", F.lit(1))
    got = own.join(roles, "match_id", "left").groupBy("patch").agg(F.count("*").alias("n_matches"), F.max("fetched_at").alias("last_fetch"), F.coalesce(F.max("has_role"), F.lit(0)).alias("has_role_data"))
    got = got.withColumn("is_stale", F.coalesce(F.lit(now_ms) - F.col("last_fetch") > stale_hours * 60 * MINUTE, F.lit(True))).withColumn("deficit", F.greatest(F.lit(0), F.lit(target) - F.col("n_matches")))
    grown = F.lit(least) + F.ceil(F.lit(float(most - least)) * F.col("deficit") / target)
    return got.withColumn("queue_target", F.when(F.col("is_stale"), most).when(F.col("deficit") == 0, least).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), grown))).cast("long"))


def match_arrivals(matches: DataFrame, now_ms: int, minutes: int = 30) -> DataFrame:
    """Matches fetched in the look-back, by patch."""
    own = visible_matches(matches).where((F.col("status") == SUCCESS) & (F.col("fetched_at") > now_ms - minutes * MINUTE) & (F.col("fetched_at") <= now_ms))
    return own.groupBy("patch").agg(F.count("*").alias("arrivals"))


def refresh_decision(arrivals: DataFrame, last_runs: DataFrame, active_patch: str, now_ms: int, threshold: int = 250, cooldown_minutes: int = 60, stale_hours: int = 12) -> DataFrame:
    """Whether each scope's analytics should run again, and why.
    last_runs: scope, patch, ran_at."""
    new = arrivals.where(F.col("patch") == active_patch).agg(F.coalesce(F.sum("arrivals"), F.lit(0)).alias("arrivals"))
    age = F.lit(now_ms) - F.col("ran_at")
    reason = (
        F.when(F.col("ran_at").isNull(), "first_run").when(age < cooldown_minutes * MINUTE, "cooldown").when(F.col("last_patch") != active_patch, "patch_changed")
        .when(age >= stale_hours * 60 * MINUTE, "stale").when(F.col("arrivals") >= threshold, "threshold").otherwise("not_enough_matches")
    )
    rows = last_runs.select("scope", F.col("patch").alias("last_patch"), "ran_at").crossJoin(F.broadcast(new)).withColumn("reason", reason)
    return rows.withColumn("run", ~F.col("reason").isin("cooldown", "not_enough_matches"))


def stale_players(summoners: DataFrame, favorites: DataFrame, n: int, cutoff_ms: int | None = None) -> DataFrame:
    """Favourites and the longest not refreshed, oldest first, distinct by name."""
    named = summoners.where("game_name is not null and tag_line is not null and platform_region is not null")
    liked = named.join(favorites.select("puuid", "platform_region").distinct(), ["puuid", "platform_region"], "left_semi")
    if cutoff_ms is not None:
        named, liked = named.where(F.col("updated_at") < cutoff_ms), liked.where(F.col("updated_at") < cutoff_ms)
    oldest = named.orderBy("updated_at", "puuid").limit(3 * n)
    both = liked.unionByName(oldest, allowMissingColumns=True)
    key = F.upper(F.concat_ws(":", "platform_region", "game_name", "tag_line"))
    once = Window.partitionBy("key").orderBy("updated_at", "puuid")
    rows = both.withColumn("key", key).withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return rows.orderBy("updated_at", "puuid").limit(n).select("puuid", "platform_region", "key", "updated_at")


def missing_timelines(matches: DataFrame, snapshots: DataFrame, state: DataFrame, n: int = 100, patch: str | None = None) -> DataFrame:
    """Ranked fetched matches without a snapshot that may still be fetched."""
    own = visible_matches(matches).where((F.col("status") == SUCCESS) & ranked_solo() & (F.col("duration") > 0))
    if patch is not None:
        own = own.where(F.col("patch") == patch)
    rows = own.join(snapshots.select("match_id").distinct(), "match_id", "left_anti").join(state.where(F.col("timeline_status") == PERMANENT_FAILURE).select("match_id"), "match_id", "left_anti")
    return rows.orderBy(F.desc("match_date"), F.desc("match_id")).limit(n).select("match_id", "patch", "match_date")


def retryable_matches(matches: DataFrame, now_ms: int, minutes: int = 30, n: int = 100) -> DataFrame:
    own = matches.where((F.col("status") == TEMPORARY_FAILURE) & (F.col("last_attempt_at") < now_ms - minutes * MINUTE))
    return own.orderBy("last_attempt_at", "match_id").limit(n).select("match_id", "retry_count", "last_attempt_at")


def pollable_players(summoners: DataFrame, favorites: DataFrame, preferences: DataFrame, n: int = 30) -> DataFrame:
    """Named players; where there are favourites, only those that somebody who
    hasn't switched polling off follows. Newest first."""
    named = summoners.where("game_name is not null and tag_line is not null")
    wanted = favorites.join(preferences.where("not live_polling_enabled").select("user_id"), "user_id", "left_anti").select("puuid", "platform_region").distinct().withColumn("wanted", F.lit(True))
    some = favorites.limit(1).agg((F.count("*") > 0).alias("any_favorite"))
    rows = named.join(wanted, ["puuid", "platform_region"], "left").crossJoin(F.broadcast(some)).where("wanted or not any_favorite")
    return rows.orderBy(F.desc("updated_at"), "puuid").limit(n).select("puuid", "platform_region", "updated_at")


def pending_match_ids(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed ids, without blanks and repeats, that aren't known yet."""
    ids = listed.select(F.trim("match_id").alias("match_id")).where("match_id <> ''").distinct()
    return ids.join(known.select("match_id").distinct(), "match_id", "left_anti")


def ladder_seeds(leagues: DataFrame, n: int = 50) -> DataFrame:
    """The n best by league points over the leagues, trimmed and distinct."""
    best = leagues.select(F.trim("puuid").alias("puuid"), "league_points").where("puuid <> ''").groupBy("puuid").agg(F.max("league_points").alias("league_points"))
    return best.orderBy(F.desc("league_points"), "puuid").limit(n)
