"""Raw match documents: the schema they are read with, and rendering them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the documents and their types.
NUMBERS = "participantId teamId championId kills deaths assists champLevel goldEarned totalDamageDealtToChampions visionScore totalMinionsKilled neutralMinionsKilled summoner1Id summoner2Id item0 item1 item2 item3 item4 item5 item6".split()
PERKS = "struct<styles: array<struct<description: string, style: int, selections: array<struct<perk: int>>>>, statPerks: struct<offense: int, flex: int, defense: int>>"
PARTICIPANT = ", ".join([*(f"{x}: int" for x in NUMBERS), "puuid: string", "teamPosition: string", "individualPosition: string", "win: boolean", f"perks: {PERKS}"])
MATCH = f"matchId string, gameCreation bigint, gameDuration int, gameVersion string, queueId int, endOfGameResult string, participantIds array<string>, participants array<struct<{PARTICIPANT}>>, teams array<struct<teamId: int, bans: array<struct<championId: int, pickTurn: int>>>>"


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match documents of a folder of JSON lines, as `m`."""
    return parse(spark.read.text(path))


#: What documents are read with for some of their tables: other fields are passed over.
FACTS_READ = f"matchId string, gameCreation bigint, gameDuration int, gameVersion string, queueId int, endOfGameResult string, participantIds array<string>, participants array<struct<{', '.join(f'{x}: int' for x in NUMBERS if not x.startswith('item'))}, puuid: string, teamPosition: string, individualPosition: string, win: boolean>>"
ITEMS_READ = f"matchId string, participants array<struct<participantId: int, {', '.join(f'item{i}: int' for i in range(7))}>>"
RUNES_READ = f"matchId string, participants array<struct<participantId: int, perks: {PERKS}>>"
HEADS_READ = "matchId string, gameCreation bigint, gameDuration int, gameVersion string, queueId int, endOfGameResult string, participants array<struct<participantId: int>>"
BANS_READ = "matchId string, teams array<struct<teamId: int, bans: array<struct<championId: int, pickTurn: int>>>>"


def parse(lines: DataFrame, col: str = "value", schema: str = MATCH) -> DataFrame:
    """Documents as `m`. Each is read once: a plain column would be read again by
    the filter and by each field that is taken of it."""
    return lines.select(F.explode(F.array(F.from_json(col, schema))).alias("m")).where("m.matchId is not null")


def render(matches: DataFrame, participants: DataFrame, bans: DataFrame, items: DataFrame, runes: DataFrame) -> DataFrame:
    """The star schema back as one JSON document a match (`value`): the inverse
    of the conforming operators, up to what they repair."""
    key = ["match_id", "participant_id"]
    slots = items.groupBy(*key).agg(*[F.max(F.when(F.col("slot") == i, F.col("item_id"))).alias(f"item{i}") for i in range(7)])
    # trees as they were meant, also where the stored row lost them
    pick = lambda t: F.transform(F.filter("r", lambda x: x["tree_kind"] == t), lambda x: F.struct(x["rune_id"].alias("perk")))
    page = runes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tree_kind", "rune_id", "style_id"))).alias("r"))
    shard = lambda i: F.get(F.transform(F.filter("r", lambda x: x["tree_kind"] == 2), lambda x: x["rune_id"]), i)
    style = lambda t: F.get(F.transform(F.filter("r", lambda x: x["tree_kind"] == t), lambda x: x["style_id"]), 0)
    one = lambda name, t: F.struct(F.lit(name).alias("description"), style(t).alias("style"), pick(t).alias("selections"))
    perks = page.select(*key, F.struct(F.array(one("subStyle", 1), one("primaryStyle", 0)).alias("styles"), F.struct(shard(0).alias("offense"), shard(1).alias("flex"), shard(2).alias("defense")).alias("statPerks")).alias("perks"))
    teams = bans.groupBy("match_id", F.col("team_id").alias("teamId")).agg(F.array_sort(F.collect_list(F.struct(F.col("champion_id").alias("championId"), F.col("pick_turn").alias("pickTurn")))).alias("bans")).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("teamId", "bans"))).alias("teams"))
    return documents(matches.join(teams, "match_id", "left"), participants.join(slots, key, "left").join(perks, key, "left"))


def player(of: Callable[[str], Column]) -> Column:
    """A player within a document, from what their columns are."""
    blank = F.when(of("participant_id") == 3, "").otherwise(of("team_position"))
    return F.struct(
        of("participant_id").alias("participantId"), F.when(F.col("match_key") % 71 == 0, F.when(of("participant_id") == 1, " ").otherwise(of("puuid"))).otherwise(of("puuid")).alias("puuid"), of("team_id").alias("teamId"), of("champion_id").alias("championId"),
        blank.alias("teamPosition"), of("team_position").alias("individualPosition"), *[of(c).alias(c) for c in ("win", "kills", "deaths", "assists")], of("champ_level").alias("champLevel"), of("gold_earned").alias("goldEarned"), of("damage").alias("totalDamageDealtToChampions"), of("vision_score").alias("visionScore"), of("minions").alias("totalMinionsKilled"), of("neutral").alias("neutralMinionsKilled"),
        (of("champion_id") % 12 + 1).alias("summoner1Id"), F.lit(4).alias("summoner2Id"), *[F.coalesce(of(f"item{i}"), F.lit(0)).alias(f"item{i}") for i in range(7)], of("perks").alias("perks"),
    )


def header() -> list[Column]:
    """What a document tells of a match, from drafts with `people`."""
    return [F.col("match_id").alias("matchId"), F.col("match_date").alias("gameCreation"), F.col("duration").alias("gameDuration"), F.concat(F.col("patch"), F.lit(".123.4567")).alias("gameVersion"), F.col("queue_id").alias("queueId"), F.lit("GameComplete").alias("endOfGameResult"), F.col("people.puuid").alias("participantIds"), F.col("teams")]


#: What a document is rendered from, of a match and of its players.
HEAD = ["match_key", "match_id", "match_date", "duration", "patch", "queue_id", "teams"]
PERSON = ["participant_id", "puuid", "team_id", "champion_id", "team_position", "win", "kills", "deaths", "assists", "champ_level", "gold_earned", "damage", "vision_score", "minions", "neutral", *(f"item{i}" for i in range(7)), "perks"]


def packed(drafts: DataFrame, players: DataFrame) -> DataFrame:
    """What documents() renders, a row a match with its players as `people`: columns
    take a third of the place of texts."""
    people = players.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("participant_id", "puuid", F.struct(*PERSON[2:]).alias("p")))).alias("people"))
    return drafts.select(*HEAD).join(people, "match_id")


def rendered(rows: DataFrame) -> DataFrame:
    """The documents of packed rows, also of a stream."""
    people = F.transform("people", lambda x: player(lambda name: x[name] if name in PERSON[:2] else x["p"][name]))
    return rows.select("match_id", F.to_json(F.struct(*header(), people.alias("participants"))).alias("value"))


def documents(drafts: DataFrame, players: DataFrame) -> DataFrame:
    """One JSON document a match (`value`). drafts: matches with `teams`; players:
    participants with item0 to item6 and `perks`."""
    people = players.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("participant_id", "puuid", F.to_json(player(F.col)).alias("p")))).alias("people"))
    got = drafts.join(people, "match_id")
    head = F.to_json(F.struct(*header()))
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"participants":['), F.concat_ws(",", "people.p"), F.lit("]}"))
    return got.select("match_id", body.alias("value"))
