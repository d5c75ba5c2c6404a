"""Player statistics, histories and look-ups, for all players at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import age_bucket, cs_per_minute, kda, queue_family, queue_label, ranked_solo, rate, role_alias
from .champions import carried_pages, rune_pages
from .scope import shared, visible_matches

#: Short names of platforms.
PLATFORM_ALIASES = {"NA": "NA1", "EUW": "EUW1", "EUNE": "EUN1", "KR": "KR", "BR": "BR1", "LAN": "LA1", "LAS": "LA2", "OCE": "OC1", "JP": "JP1", "TR": "TR1"}
SLOTS = 7


def ranked_games(matches: DataFrame, participants: DataFrame) -> DataFrame:
    """A player's ranked solo games; any match that isn't hidden counts."""
    own = visible_matches(matches).where(ranked_solo()).select("match_id", "match_date", "duration", "patch")
    return participants.join(own, "match_id")


def measures() -> list[Column]:
    wins = F.count_if("win")
    kills, deaths, assists = F.avg("kills"), F.avg("deaths"), F.avg("assists")
    return [
        F.count("*").alias("games"), wins.alias("wins"), (F.count("*") - wins).alias("losses"), (F.lit(100.0) * wins / F.count("*")).alias("win_rate_pct"), kills.alias("avg_kills"), deaths.alias("avg_deaths"), assists.alias("avg_assists"),
        kda(kills, assists, deaths).alias("kda_ratio"), F.avg("vision_score").alias("avg_vision"), F.avg("damage").alias("avg_damage"), F.avg(cs_per_minute()).alias("avg_cs_per_min"), F.avg(F.col("duration") / 60).alias("avg_minutes"),
    ]


def player_overview(matches: DataFrame, participants: DataFrame) -> DataFrame:
    return ranked_games(matches, participants).groupBy("puuid").agg(*measures())


def recent_performance(matches: DataFrame, participants: DataFrame, n: int = 20) -> DataFrame:
    order = Window.partitionBy("puuid").orderBy(F.desc("match_date"), F.desc("match_id"), "participant_id")
    rows = ranked_games(matches, participants).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return rows.select("puuid", "place", "match_id", "champion_id", "win", "kills", "deaths", "assists", kda(F.col("kills"), F.col("assists"), F.col("deaths")).alias("kda_ratio"), cs_per_minute().alias("cs_per_min"), "vision_score", "damage")


def player_champions(matches: DataFrame, participants: DataFrame, top: int = 10) -> DataFrame:
    groups = ranked_games(matches, participants).groupBy("puuid", "champion_id").agg(*measures())
    order = Window.partitionBy("puuid").orderBy(F.desc("games"), F.desc("wins"), "champion_id")
    return groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def player_roles(matches: DataFrame, participants: DataFrame) -> DataFrame:
    position = F.upper(F.trim("team_position"))
    role = F.when(position.isNull() | (position == ""), "UNKNOWN").otherwise(position)
    groups = ranked_games(matches, participants).groupBy("puuid", role.alias("role")).agg(F.count("*").alias("games"), F.count_if("win").alias("wins"))
    return groups.withColumn("losses", F.col("games") - F.col("wins")).withColumn("win_rate_pct", 100.0 * F.col("wins") / F.col("games"))


def packed_items(items: DataFrame) -> DataFrame:
    """Items of a participant in slot order, zeros dropped, cut and padded to 7."""
    listed = items.where("item_id <> 0").groupBy("match_id", "participant_id").agg(F.sort_array(F.collect_list(F.struct("slot", "item_id"))).alias("i"))
    return listed.select("match_id", "participant_id", F.slice(F.concat(F.transform("i", lambda x: x["item_id"]), F.array_repeat(F.lit(0), SLOTS)), 1, SLOTS).alias("items"))


def in_slots(listed: Column) -> Column:
    """The items of an array of (slot, item_id) as `packed_items` gives them."""
    worn = F.sort_array(F.filter(listed, lambda x: x["item_id"] != 0))["item_id"]
    return F.slice(F.concat(worn, F.array_repeat(F.lit(0), SLOTS)), 1, SLOTS)


def match_history(matches: DataFrame, participants: DataFrame, items: DataFrame | None, runes: DataFrame | None, rune_versions: DataFrame, page: int = 1, size: int = 20, family: str | None = None, queue_ids: list[int] | None = None, short: bool = False, carried: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One page of every player's matches, with totals, items and runes. A player's
    matches meet once: they are counted, then limited to the page, and items and
    runes are reduced to the page's rows before they are gathered; with `short`,
    for players who have hardly more matches than a page, they are gathered as they
    are, since there is little to reduce. Where a participant's row tells its items
    and runes, `carried` adds them to the page's rows as arrays `items` (slot, item_id)
    and `runes` (tree, idx, rune_id, style_id), and no tables of them are gathered."""
    size = max(1, min(size, 100))
    own = visible_matches(matches)
    queue = F.when((F.col("queue_id") == 0), F.coalesce(F.col("queue_type").try_cast("int"), F.lit(0))).otherwise(F.col("queue_id"))
    if family and family.upper() != "ALL":
        own = own.where(queue_family(queue) == family.upper())
    if queue_ids:
        own = own.where(F.col("queue_id").isin(queue_ids) | F.col("queue_type").isin([str(q) for q in queue_ids]))
    rows = participants.join(own.select("match_id", "match_date", "patch", queue.alias("queue")), "match_id")
    if not carried:
        rows = rows.select("puuid", "match_id", "participant_id", "match_date", "champion_id", "win", "queue")
    # sorted once for both windows
    order = [F.desc("match_date"), F.desc("match_id"), "participant_id"]
    rows = rows.repartition("puuid").sortWithinPartitions("puuid", *order)
    player = Window.partitionBy("puuid")
    rows = rows.withColumn("total", F.count("*").over(player)).withColumn("place", F.row_number().over(player.orderBy(*order)))
    rows = rows.where((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size))
    key = ["match_id", "participant_id"]
    if carried:
        rows = carried_pages(carried(rows), rune_versions, "history").withColumn("items", in_slots(F.col("items")))
    else:
        if not short:
            rows = shared(rows)
            listed = rows.select(*key).distinct()
            items, runes = (df.join(listed, key, "left_semi") for df in (items, runes))
        rows = rows.join(packed_items(items), key, "left").join(rune_pages(runes, rune_versions, "history"), key, "left")
    return rows.select(
        "puuid", "place", "total", F.ceil(F.col("total") / size).alias("pages"), "match_id", "match_date", "champion_id", "win", queue_label(F.col("queue")).alias("queue_label"), queue_family(F.col("queue")).alias("queue_family"),
        F.coalesce("items", F.array_repeat(F.lit(0), SLOTS)).alias("items"), "primary_style", "sub_style", F.get("primary", 0).alias("keystone"), "rune_key",
    )


def match_detail(matches: DataFrame, participants: DataFrame, items: DataFrame, runes: DataFrame, rune_versions: DataFrame) -> DataFrame:
    """Matches with a nested array of participants, each with items and runes."""
    key = ["match_id", "participant_id"]
    rows = participants.join(packed_items(items), key, "left").join(rune_pages(runes, rune_versions, "detail"), key, "left")
    one = F.struct("participant_id", "team_id", "puuid", "champion_id", "team_position", "win", "kills", "deaths", "assists", "damage", "gold_earned", "items", "primary_style", "sub_style", "primary", "sub", "shards")
    nested = rows.groupBy("match_id").agg(F.array_sort(F.collect_list(one)).alias("participants"))
    return visible_matches(matches).select("match_id", "match_date", "duration", "patch", "queue_id").join(nested, "match_id")


def lane_alignment(matches: DataFrame, participants: DataFrame) -> DataFrame:
    """Blue and red players of a match side by side, by role and order."""
    rows = participants.join(visible_matches(matches).select("match_id"), "match_id", "left_semi").withColumn("role", role_alias(F.col("team_position")))
    nth = F.row_number().over(Window.partitionBy("match_id", "team_id", "role").orderBy("participant_id"))
    rows = rows.withColumn("nth", nth)
    of = lambda team, c: F.max(F.when(F.col("team_id") == team, F.col(c)))
    both = rows.where(F.col("team_id").isin(100, 200)).groupBy("match_id", "role", "nth").agg(of(100, "puuid").alias("blue_puuid"), of(100, "champion_id").alias("blue_champion"), of(200, "puuid").alias("red_puuid"), of(200, "champion_id").alias("red_champion"))
    known = F.array_position(F.array(*[F.lit(r) for r in ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")]), F.col("role"))
    rank = F.when(F.col("role") == "UNKNOWN", 99).when(known > 0, known).otherwise(50)
    return both.withColumn("lane", F.row_number().over(Window.partitionBy("match_id").orderBy(rank, "role", "nth")))


def player_profile(summoners: DataFrame, ranks: DataFrame, matches: DataFrame, participants: DataFrame, now_ms: int) -> DataFrame:
    """Newest ranks, overview, best champions and last games of every player, and the
    ages of the profile, of the solo rank and of the statistics (that of the last
    match in any queue)."""
    newest = ranks.groupBy("puuid", "queue_type").agg(F.max_by(F.struct("tier", "division", "league_points", "wins", "losses", "updated_at"), "updated_at").alias("r"))
    of = lambda q, name: newest.where(F.col("queue_type") == q).select("puuid", F.col("r").alias(name))
    champions = player_champions(matches, participants, 5).groupBy("puuid").agg(F.array_sort(F.collect_list(F.struct("place", "champion_id", "games", "win_rate_pct"))).alias("champions"))
    recent = recent_performance(matches, participants, 10).groupBy("puuid").agg(F.array_sort(F.collect_list(F.struct("place", "match_id", "champion_id", "win"))).alias("recent"))
    out = summoners.select("puuid", "game_name", "tag_line", "summoner_level", age_bucket(F.col("updated_at"), now_ms).alias("profile_age"))
    last = participants.select("puuid", "match_id").join(visible_matches(matches).select("match_id", "match_date"), "match_id").groupBy("puuid").agg(age_bucket(F.max("match_date"), now_ms).alias("stats_age"))
    for part in (of("RANKED_SOLO_5x5", "solo"), of("RANKED_FLEX_SR", "flex"), player_overview(matches, participants), champions, recent, last):
        out = out.join(part, "puuid", "left")
    return out.withColumn("rank_age", age_bucket(F.col("solo.updated_at"), now_ms)).withColumn("solo_win_rate", rate(F.col("solo.wins"), F.col("solo.wins") + F.col("solo.losses")))


def platform_of(text: Column) -> Column:
    """A platform code from a code or a short name, blanks and signs ignored."""
    plain = F.upper(F.regexp_replace(text, "[ _-]", ""))
    out = None
    for short, code in PLATFORM_ALIASES.items():
        out = (F if out is None else out).when(plain == short, code)
    return out.otherwise(plain)


def find_by_name(wanted: DataFrame, summoners: DataFrame) -> DataFrame:
    """The player of each (request, game_name, tag_line, platform): by trimmed
    upper-case key first, then as written, then by upper case as stored."""
    norm = lambda c: F.upper(F.trim(c))
    w = wanted.select("request", "game_name", "tag_line", platform_of(F.col("platform")).alias("platform_region"), norm("game_name").alias("_g"), norm("tag_line").alias("_t"))
    p = summoners.select("puuid", F.col("game_name").alias("g"), F.col("tag_line").alias("t"), "platform_region", "updated_at", norm("game_name").alias("_g"), norm("tag_line").alias("_t"))
    as_written = (F.col("g") == F.col("game_name")) & (F.col("t") == F.col("tag_line"))
    in_capitals = (F.upper("g") == F.upper("game_name")) & (F.upper("t") == F.upper("tag_line"))
    priority = F.when(F.col("g") == F.trim("g"), 1).when(as_written, 2).when(in_capitals, 3)
    found = w.join(p, ["_g", "_t", "platform_region"]).withColumn("priority", priority).where("priority is not null")
    order = Window.partitionBy("request").orderBy("priority", F.desc("updated_at"), "puuid")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("request", "puuid", "priority")


def queue_facets(matches: DataFrame, participants: DataFrame) -> DataFrame:
    """Queues of each player's history with label and count."""
    own = visible_matches(matches)
    facet = F.when(F.col("queue_id") > 0, F.concat(F.lit("id:"), F.col("queue_id").cast("string"))).otherwise(F.concat(F.lit("type:"), F.coalesce("queue_type", F.lit(""))))
    label = F.when(F.col("queue_id") > 0, queue_label(F.col("queue_id"))).otherwise(queue_label(F.coalesce(F.col("queue_type").try_cast("int"), F.lit(0))))
    rows = participants.join(own.select("match_id", facet.alias("facet"), label.alias("label")), "match_id")
    return rows.groupBy("puuid", "facet", "label").agg(F.count("*").alias("games"))
