"""Live games: states, transitions and team analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import kda, rate, tier_score
from .scope import visible_matches

#: Seconds until a player in a state is looked at again.
POLL_SECONDS = {"lobby": 30, "in_game": 60, "ended": 30}
OTHER_POLL_SECONDS = 300


def poll_seconds(state: F.Column) -> F.Column:
    out = None
    for name, seconds in POLL_SECONDS.items():
        out = (F if out is None else out).when(state == name, seconds)
    return out.otherwise(OTHER_POLL_SECONDS)


def live_state_latest(snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Latest observation of each player and whether the next look is due."""
    last = snapshots.groupBy("puuid", "platform_region").agg(F.max_by(F.struct("state", "game_id", "observed_at"), F.struct("observed_at", "event_id")).alias("s"))
    due = F.col("s.observed_at") + poll_seconds(F.col("s.state")) * 1000
    return last.select("puuid", "platform_region", "s.state", "s.game_id", "s.observed_at", due.alias("next_poll_at"), (due <= now_ms).alias("is_due"))


def live_game_ended(snapshots: DataFrame) -> DataFrame:
    """Players that went from a game to offline, with the game's id."""
    order = Window.partitionBy("puuid", "platform_region").orderBy("observed_at", "event_id")
    rows = snapshots.withColumn("was", F.lag("state").over(order)).withColumn("ended_game_id", F.lag("game_id").over(order))
    return rows.where("was = 'in_game' and state = 'offline'").select("puuid", "platform_region", "ended_game_id", "observed_at")


RAW_GAME = "gameId bigint, gameQueueConfigId int, mapId int, gameStartTime bigint, gameLength bigint, participants array<struct<puuid: string, teamId: int, championId: int>>"


def live_games(raw: DataFrame, players: DataFrame) -> DataFrame:
    """One row for each asked player and participant of the game that the player
    is in; players without a game are offline and have no participants.
    raw: puuid, body (JSON)."""
    parsed = raw.select("puuid", F.from_json("body", RAW_GAME).alias("g")).where("g is not null")
    rows = players.select("puuid").join(parsed, "puuid", "left")
    rows = rows.select("puuid", F.when(F.col("g").isNull(), "offline").otherwise("in_game").alias("state"), F.col("g.gameId").alias("game_id"), F.col("g.gameQueueConfigId").alias("queue_id"), F.col("g.gameStartTime").alias("started_at"), F.col("g.gameLength").alias("game_length"), F.explode_outer("g.participants").alias("p"))
    return rows.select("puuid", "state", "game_id", "queue_id", "started_at", "game_length", F.col("p.puuid").alias("participant_puuid"), F.col("p.teamId").alias("team_id"), F.col("p.championId").alias("champion_id"))


def live_participants(live: DataFrame, summoners: DataFrame, ranks: DataFrame, matches: DataFrame, participants: DataFrame, winrates: DataFrame, compat: bool = False) -> DataFrame:
    """Players of live games (game_id, team_id, puuid, champion_id) with the newest
    summoner row of their puuid, its solo tier, division and points, win rate and
    KDA over all queues (null without such a row), and the champion's win rate. The
    tables are reduced to the live players before anything is aggregated."""
    scale = 100.0 if compat else 1.0
    asked = live.select("puuid").where("puuid is not null").distinct()
    summoners, ranks, participants = (df.join(asked, "puuid", "left_semi") for df in (summoners, ranks, participants))
    known = summoners.groupBy("puuid").agg(F.max_by("game_name", F.struct("updated_at", "summoner_id")).alias("game_name"), F.lit(True).alias("_known"))
    solo = ranks.where(F.col("queue_type") == "RANKED_SOLO_5x5").select("puuid", "tier", "division", "league_points")
    played = participants.join(visible_matches(matches).select("match_id"), "match_id", "left_semi")
    kills, deaths, assists = F.avg("kills"), F.avg("deaths"), F.avg("assists")
    stats = played.groupBy("puuid").agg((scale * F.count_if("win") / F.count("*")).alias("recent_win_rate"), kda(kills, assists, deaths).alias("recent_kda"))
    champion = winrates.groupBy("champion_id").agg((F.sum(F.col("win_rate") * F.col("games")) / F.sum("games")).alias("champion_win_rate"))
    rows = live.join(known, "puuid", "left").join(solo, "puuid", "left").join(stats, "puuid", "left").join(champion, "champion_id", "left")
    own = lambda c: F.when(F.col("_known"), F.col(c)).alias(c)
    return rows.select(*live.columns, "game_name", *map(own, ("tier", "division", "league_points", "recent_win_rate", "recent_kda")), "champion_win_rate")


def live_team_analysis(rows: DataFrame) -> DataFrame:
    """Scores, strengths, weaknesses and win probability of the teams."""
    known = F.when(F.col("tier").isNotNull(), tier_score(F.col("tier")))
    teams = rows.groupBy("game_id", "team_id").agg(F.coalesce(F.avg("recent_win_rate"), F.lit(0.5)).alias("recent"), F.coalesce(F.avg("champion_win_rate"), F.lit(0.5)).alias("champion"), F.coalesce(F.avg(known), F.lit(3.0)).alias("rank"))
    rank = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rank") / 10))
    teams = teams.withColumn("rank_share", rank).withColumn("score", 0.4 * F.col("recent") + 0.4 * F.col("champion") + 0.2 * rank)
    notes = lambda better: F.concat_ws(",", F.array_compact(F.array(*[F.when(F.col(c) >= hi if better else F.col(c) <= lo, name) for c, name, hi, lo in (("recent", "recent_form", 0.52, 0.48), ("champion", "champion_pool", 0.51, 0.49), ("rank_share", "rank", 0.55, 0.35))])))
    whole = Window.partitionBy("game_id")
    teams = teams.withColumn("n_teams", F.count("*").over(whole)).withColumn("sum_score", F.sum("score").over(whole))
    return teams.select("game_id", "team_id", "recent", "champion", "rank", "score", notes(True).alias("strengths"), notes(False).alias("weaknesses"), F.when(F.col("n_teams") == 2, rate(F.col("score"), F.greatest(F.lit(0.0001), F.col("sum_score")))).alias("win_probability"))
