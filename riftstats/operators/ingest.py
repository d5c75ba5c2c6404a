"""Conforming raw documents and keeping tables up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import OUTSIDE_RETENTION, PERMANENT_FAILURE, RANKED_SOLO, SUCCESS, TEMPORARY_FAILURE, UNFETCHED, blank_to_null, in_history_scope, match_platform, patch_order, queue_family, queue_label
from .merging import last_of_each, upserted

DAY = 86_400_000
MATCH_DELAYS, MAX_MATCH_FAILURES, RETENTION_DAYS = [30, 60, 120, 300], 5, 730
#: Selection trees of runes, and the path that stat shards have.
PRIMARY, SECONDARY, SHARDS, SHARD_PATH = 0, 1, 2, 5000


def short_patch(version: Column) -> Column:
    """The first two parts of a version, null if it is blank."""
    return F.array_join(F.slice(F.split(blank_to_null(version), r"\."), 1, 2), ".")


def match_headers(raw: DataFrame) -> DataFrame:
    """One row a raw match, as fetched."""
    m = raw.select(F.inline(F.array("m")))
    return m.select(F.col("matchId").alias("match_id"), F.col("gameCreation").alias("match_date"), F.col("gameDuration").alias("duration"), short_patch(F.col("gameVersion")).alias("patch"), F.col("queueId").alias("queue_id"), queue_label(F.col("queueId")).alias("queue_type"), F.lit(SUCCESS).alias("status"), F.col("endOfGameResult").alias("end_of_game_result"), F.size("participants").alias("n_participants"))


#: Names of a participant's columns and the fields that they come from.
PARTICIPANT_FIELDS = {
    "participant_id": "participantId", "team_id": "teamId", "champion_id": "championId", "win": "win", "kills": "kills", "deaths": "deaths", "assists": "assists", "champ_level": "champLevel", "gold_earned": "goldEarned", "damage": "totalDamageDealtToChampions",
    "vision_score": "visionScore", "minions": "totalMinionsKilled", "neutral": "neutralMinionsKilled", "spell1": "summoner1Id", "spell2": "summoner2Id",
}


def unknown_players(raw: DataFrame, known: DataFrame) -> DataFrame:
    """The puuids of raw matches, each once, that aren't known."""
    seen = raw.select(F.explode("m.participants").alias("p")).select(blank_to_null(F.col("p.puuid")).alias("puuid"))
    return seen.where("puuid is not null").distinct().join(known.select("puuid"), "puuid", "left_anti")


def match_facts(raw: DataFrame, known: DataFrame | None, mode: str = "strict", unknown: DataFrame | None = None) -> DataFrame:
    """Participants of raw matches. strict: a match with a blank or unknown
    puuid, or with other counts than it lists, is left out as a whole; lenient:
    blank ones are dropped and unknown ones marked as stubs. unknown: the players of
    raw that aren't known, if they are at hand; being few, they can be sent to the
    rows, which else meet all known ones."""
    m = raw.select(F.inline(F.array("m"))).withColumn("n_listed", F.size("participantIds"))
    position = F.coalesce(blank_to_null(F.col("p.teamPosition")), blank_to_null(F.col("p.individualPosition")))
    rows = m.select("matchId", "gameCreation", "gameDuration", "gameVersion", "queueId", "endOfGameResult", "n_listed", F.explode("participants").alias("p"))
    rows = rows.select(
        F.col("matchId").alias("match_id"), F.col("gameCreation").alias("match_date"), F.col("gameDuration").alias("duration"), short_patch(F.col("gameVersion")).alias("patch"), F.col("queueId").alias("queue_id"), F.col("endOfGameResult").alias("end_of_game_result"), "n_listed",
        blank_to_null(F.col("p.puuid")).alias("puuid"), position.alias("team_position"), *[F.col(f"p.{field}").alias(name) for name, field in PARTICIPANT_FIELDS.items()],
    )
    if unknown is not None:
        rows = rows.join(unknown.select("puuid", F.lit(True).alias("_stub")), "puuid", "left").withColumn("is_stub", F.col("puuid").isNull() | F.col("_stub").isNotNull()).drop("_stub")
    else:
        rows = rows.join(known.select("puuid").distinct().withColumn("_known", F.lit(True)), "puuid", "left").withColumn("is_stub", F.col("_known").isNull()).drop("_known")
    if mode == "strict":
        whole = Window.partitionBy("match_id")
        bad = F.max(F.col("puuid").isNull() | F.col("is_stub")).over(whole) | (F.count("*").over(whole) != F.col("n_listed"))
        rows = rows.withColumn("_bad", bad).where("not _bad").drop("_bad")
    else:
        rows = rows.where("puuid is not null")
    return rows.drop("n_listed")


def participant_runes(raw: DataFrame, *carried: str) -> DataFrame:
    """Rune selections of raw matches, numbered within their tree; other columns of
    raw go along if they are named."""
    rows = raw.select(*carried, F.col("m.matchId").alias("match_id"), F.explode("m.participants").alias("p")).select(*carried, "match_id", F.col("p.participantId").alias("participant_id"), F.col("p.perks").alias("k"))
    named = lambda name: F.get(F.filter("k.styles", lambda s: s["description"] == name), 0)
    rows = rows.withColumn("a", F.coalesce(named("primaryStyle"), F.get("k.styles", 0)))
    rows = rows.withColumn("b", F.coalesce(named("subStyle"), F.get(F.filter("k.styles", lambda s: s["style"] != F.col("a.style")), 0)))

    def tree(n: int, style: str) -> Column:
        kept = F.filter(F.transform(f"{style}.selections", lambda s: s["perk"]), lambda x: x != 0)
        return F.transform(kept, lambda x, i: F.struct(F.lit(n).alias("tree"), i.alias("idx"), x.alias("rune_id"), F.col(f"{style}.style").alias("style_id")))

    places = F.array(*[F.struct(F.lit(SHARDS).alias("tree"), F.lit(i).alias("idx"), F.col(f"k.statPerks.{name}").alias("rune_id"), F.lit(0).alias("style_id")) for i, name in enumerate(("offense", "flex", "defense"))])
    trees = [tree(PRIMARY, "a"), tree(SECONDARY, "b"), F.filter(places, lambda x: x["rune_id"] != 0)]
    # all trees of a participant at once, as each pass over the documents reads them again; a missing tree is empty
    return rows.select(*carried, "match_id", "participant_id", F.inline(F.flatten(F.array_compact(F.array(*trees)))))


def participant_items(raw: DataFrame, *carried: str) -> DataFrame:
    rows = raw.select(*carried, F.col("m.matchId").alias("match_id"), F.explode("m.participants").alias("p"))
    return rows.select(*carried, "match_id", F.col("p.participantId").alias("participant_id"), F.posexplode(F.array(*[f"p.item{i}" for i in range(7)])).alias("slot", "item_id")).where("item_id <> 0")


def match_bans(raw: DataFrame, *carried: str) -> DataFrame:
    teams = raw.select(*carried, F.col("m.matchId").alias("match_id"), F.explode("m.teams").alias("t"))
    return teams.select(*carried, "match_id", F.col("t.teamId").alias("team_id"), F.explode("t.bans").alias("b")).select(*carried, "match_id", "team_id", F.col("b.pickTurn").alias("pick_turn"), F.col("b.championId").alias("champion_id")).where("champion_id > 0")


def conform_queue(matches: DataFrame) -> DataFrame:
    """Queue id (also from text), family and label of every match."""
    queue = F.when(F.col("queue_id") != 0, F.col("queue_id")).otherwise(F.coalesce(F.col("queue_type").try_cast("int"), F.lit(0)))
    return matches.select("match_id", queue.alias("queue_id"), queue_family(queue).alias("queue_family"), queue_label(queue).alias("queue_label"))


def patch_dimension(versions: DataFrame, matches: DataFrame, patches: DataFrame, now_ms: int) -> DataFrame:
    """Patches with those that versions and matches add; the newest is active."""
    seen = versions.select(short_patch(F.col("version")).alias("patch")).unionByName(matches.select("patch")).where("patch is not null and patch <> ''").distinct()
    new = seen.join(patches, "patch", "left_anti").select("patch", F.lit(now_ms).cast("long").alias("released_at"))
    every = patches.select("patch", "released_at").unionByName(new)
    newest = every.agg(F.max_by("patch", patch_order(F.col("patch"))).alias("newest"))
    return every.crossJoin(F.broadcast(newest)).select("patch", "released_at", (F.col("patch") == F.col("newest")).alias("is_active"))


def rune_versions(perks: DataFrame, styles: DataFrame, current: DataFrame) -> DataFrame:
    """Runes of each patch with name, description, path and slot, over the current
    rows. perks: patch, rune_id, key, name, short_desc, long_desc, tooltip; styles:
    patch, place, style_id, style_name, slots array<struct<kind, runes>>. Stat
    slots and others count on their own within a style; the first occurrence of a
    rune counts; a rune that no style has gets path and slot 0. A missing name is
    made from the id; the description is the first text that isn't blank."""
    slots = styles.select("patch", "place", "style_id", "style_name", F.posexplode("slots").alias("pos", "s")).withColumn("stat", F.lower("s.kind") == "kstatmod")
    within = Window.partitionBy("patch", "place", "style_id", "stat").orderBy("pos")
    slots = slots.withColumn("slot", F.row_number().over(within) - 1)
    path, name = F.when(F.col("stat"), SHARD_PATH).otherwise(F.col("style_id")), F.when(F.col("stat"), "Stat Mods").otherwise(F.col("style_name"))
    runes = slots.select("patch", "place", "pos", "slot", path.alias("path_id"), name.alias("path_name"), F.posexplode("s.runes").alias("i", "rune_id")).where("rune_id <> 0")
    first = Window.partitionBy("patch", "rune_id").orderBy("place", "pos", "i")
    placed = runes.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("patch", "rune_id", "path_id", "path_name", "slot")
    text = F.coalesce(blank_to_null(F.col("short_desc")), blank_to_null(F.col("long_desc")), F.col("tooltip"), F.lit(""))
    rows = perks.join(placed, ["patch", "rune_id"], "left").select(
        "rune_id", "patch", "key", F.coalesce(blank_to_null(F.col("name")), F.concat(F.lit("Rune "), F.col("rune_id").cast("string"))).alias("name"), text.alias("description"),
        F.coalesce("path_id", F.lit(0)).alias("path_id"), "path_name", F.coalesce("slot", F.lit(0)).alias("slot"),
    )
    return upserted(current.select(*rows.columns), rows, ["rune_id", "patch"])


def item_versions(raw_items: DataFrame, current: DataFrame) -> DataFrame:
    """Items of each patch with clean lists and defaults, over the current rows."""
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda x: x > 0)))
    words = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    lower = F.transform(words, lambda t: F.lower(t))
    tags = F.array_sort(F.filter(words, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1))
    rows = raw_items.where("item_id > 0").select("item_id", "patch", F.coalesce("in_store", F.lit(True)).alias("in_store"), F.coalesce("price_total", F.lit(0)).alias("price_total"), ids(F.col("builds_into")).alias("builds_into"), ids(F.col("builds_from")).alias("builds_from"), tags.alias("tags"))
    return upserted(current.select(*rows.columns), rows, ["item_id", "patch"])


def upsert_summoners(current: DataFrame, incoming: DataFrame, mentioned: DataFrame) -> DataFrame:
    """The newest row of each puuid, names trimmed and with upper-case keys;
    puuids that are only mentioned become stubs that keep an old timestamp. The
    result may be the current table of the next run."""
    cols = ["puuid", "summoner_id", "game_name", "tag_line", "platform_region", "updated_at", "is_stub"]
    whole = lambda df, new: df.withColumns({c: v for c, v in {"summoner_id": F.lit(None).cast("long"), "is_stub": F.lit(False)}.items() if c not in df.columns}).select(*cols, F.lit(new).alias("_new"))
    both = whole(current, 0).unionByName(whole(incoming, 1))
    both = both.withColumn("puuid", blank_to_null(F.col("puuid"))).where("puuid is not null")
    order = Window.partitionBy("puuid").orderBy(F.desc("updated_at"), F.desc("summoner_id"), F.desc("_new"))
    rows = both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("puuid", F.trim("game_name").alias("game_name"), F.trim("tag_line").alias("tag_line"), "platform_region", "updated_at", "is_stub")
    stubs = mentioned.select(blank_to_null(F.col("puuid")).alias("puuid")).where("puuid is not null").distinct().join(rows, "puuid", "left_anti")
    none = F.lit(None).cast("string")
    rows = rows.unionByName(stubs.select("puuid", none.alias("game_name"), none.alias("tag_line"), none.alias("platform_region"), F.lit(0).cast("long").alias("updated_at"), F.lit(True).alias("is_stub")))
    return rows.withColumn("name_key", F.upper("game_name")).withColumn("tag_key", F.upper("tag_line"))


RANK_VALUES = ["tier", "division", "league_points", "wins", "losses"]


RANK_KEY = ["puuid", "queue_type"]


def upsert_ranks(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current ranks after the incoming observations, the newest (by updated_at, if
    they have it) of each player and queue."""
    new = last_of_each(incoming, RANK_KEY, "updated_at" if "updated_at" in incoming.columns else None)
    return upserted(current.select(*RANK_KEY, *RANK_VALUES), new.select(*RANK_KEY, *RANK_VALUES), RANK_KEY)


def rank_history(current: DataFrame, incoming: DataFrame, history: DataFrame) -> DataFrame:
    """States that a later one replaces and that history hasn't yet, each once. The
    current row and the incoming observations of a player and queue are one
    sequence, in the order of updated_at (if they have it)."""
    at = F.col("updated_at") if "updated_at" in incoming.columns else F.lit(0)
    seen = current.select(*RANK_KEY, *RANK_VALUES, F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_at")).unionByName(incoming.select(*RANK_KEY, *RANK_VALUES, F.lit(1).alias("_new"), at.cast("long").alias("_at")))
    state = F.struct(*RANK_VALUES)
    after = F.lead(state).over(Window.partitionBy(*RANK_KEY).orderBy("_new", "_at", *RANK_VALUES))
    replaced = seen.withColumn("_after", after).where(F.col("_after").isNotNull() & ~state.eqNullSafe(F.col("_after"))).select(*RANK_KEY, *RANK_VALUES).distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*RANK_KEY, *RANK_VALUES)]
    return replaced.alias("r").join(history.alias("h"), same, "left_anti")


def insert_new_matches(existing: DataFrame, incoming: DataFrame, patch: str | None = None, history_scope: bool = True) -> DataFrame:
    """Incoming matches that aren't there, hidden ones included, once each."""
    rows = incoming
    if patch is not None:
        rows = rows.where(F.lower("patch") == patch.lower())
    if history_scope:
        rows = rows.where(in_history_scope(F.col("queue_id")))
    once = Window.partitionBy("match_id").orderBy("match_date", "patch")
    return rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").join(existing.select("match_id").distinct(), "match_id", "left_anti")


def timeline_snapshots(matches: DataFrame, participants: DataFrame, frames: DataFrame, minute: int = 15) -> DataFrame:
    """The last frame up to the minute mark, else the earliest, of each
    participant, with flags of how it was got. All three tables meet by match."""
    mark = minute * 60_000
    whole = Window.partitionBy("match_id")
    before = F.max(F.when(F.col("timestamp_ms") <= mark, F.col("timestamp_ms"))).over(whole)
    rows = frames.withColumns({"_before": before, "_first": F.min("timestamp_ms").over(whole)}).where(F.col("timestamp_ms") == F.coalesce("_before", "_first"))
    who = participants.groupBy("match_id").agg(F.collect_list(F.struct("puuid", "participant_id")).alias("who"))
    by_puuid = F.get(F.transform(F.filter("who", lambda w: w["puuid"] == F.col("puuid")), lambda w: w["participant_id"]), 0)
    rows = rows.join(who, "match_id", "left").withColumn("participant_id", F.coalesce("participant_id", by_puuid)).where("participant_id is not null")
    rows = rows.join(matches.select("match_id", "duration"), "match_id")
    how = F.when(F.col("_before").isNull(), "AFTER_TARGET").when(F.col("timestamp_ms") == mark, "EXACT").otherwise("PRIOR_FRAME")
    flags = F.concat_ws("|", how, F.when(F.col("duration") < minute * 60, "SHORT_GAME"))
    return rows.select("match_id", "participant_id", F.lit(minute).alias("minute_mark"), F.col("total_gold").alias("gold"), "xp", "cs", "level", "timestamp_ms", flags.alias("quality_flags"))


def replaced(current: DataFrame, new: DataFrame, keys: list[str], among: Column | None = None) -> DataFrame:
    """Rows after new ones, which replace all that their keys had: snapshots of a
    match and minute mark, rune selections of a participant. among: what all rows
    of such keys fulfil, if that is known; others stay without meeting the keys."""
    met, apart = current, None
    if among is not None:
        among = F.coalesce(among, F.lit(False))
        met, apart = current.where(among), current.where(~among)
    rows = met.join(new.select(*keys).distinct(), keys, "left_anti")
    return (rows if apart is None else rows.unionByName(apart)).unionByName(new.select(*current.columns))


def placeless() -> Column:
    """Rows of rune selections without tree, place and style, as lost ones are
    (unknown values don't tell)."""
    return F.coalesce((F.col("tree") == 0) & (F.col("idx") == 0) & (F.col("style_id") == 0), F.lit(True))


def backfill_rune_selections(runes: DataFrame, versions: DataFrame) -> DataFrame:
    """New trees, styles and places of participants whose rows have all lost
    them (tree 0, place 0, style 0)."""
    key = ["match_id", "participant_id"]
    lost = runes.groupBy(*key).agg(F.bool_and(placeless()).alias("lost")).where("lost").select(*key)
    # all rows of such a participant are placeless, so no others have to meet the keys; a patch has about a hundred runes
    rows = runes.where(placeless()).join(lost, key, "left_semi").join(F.broadcast(versions.select("rune_id", "patch", "path_id", "slot")), ["rune_id", "patch"], "left")
    counted = rows.where((F.col("path_id") > 0) & (F.col("path_id") < SHARD_PATH)).groupBy(*key, "path_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*key).orderBy(F.desc("n"), "path_id")
    placed = counted.withColumn("nth", F.row_number().over(order))
    paths = placed.groupBy(*key).agg(F.max(F.when(F.col("nth") == 1, F.col("path_id"))).alias("p1"), F.max(F.when(F.col("nth") == 2, F.col("path_id"))).alias("p2"))
    rows = rows.join(paths, key, "left")
    known = F.col("path_id").isNotNull()
    in_primary = F.count(F.when(known & (F.col("path_id") == F.col("p1")), 1)).over(Window.partitionBy(*key))
    unknown_nth = F.sum(F.when(~known, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("rune_id").rowsBetween(Window.unboundedPreceding, 0))
    tree = (
        F.when(known & (F.col("path_id") >= SHARD_PATH), SHARDS).when(known & (F.col("path_id") == F.col("p1")), PRIMARY).when(known, SECONDARY)
        .when(in_primary + unknown_nth <= 4, PRIMARY).otherwise(SECONDARY)
    )
    style = F.when(F.col("new_tree") == SHARDS, 0).when(F.col("new_tree") == PRIMARY, F.coalesce("p1", F.lit(0))).otherwise(F.when(known & (F.col("path_id") > 0), F.col("path_id")).otherwise(F.coalesce("p2", F.lit(0))))
    rows = rows.withColumn("new_tree", tree)
    place = F.row_number().over(Window.partitionBy(*key, "new_tree").orderBy(F.coalesce("slot", F.lit(0)), "rune_id")) - 1
    return rows.select(*key, "rune_id", F.col("new_tree").alias("tree"), place.alias("idx"), style.alias("style_id"))


def backfill_match_status(matches: DataFrame, participants: DataFrame, now_ms: int) -> DataFrame:
    """Unfetched matches that have participants become fetched."""
    have = participants.select("match_id").distinct().withColumn("_have", F.lit(True))
    fix = (F.col("status") == UNFETCHED) & F.col("_have")
    rows = matches.join(have, "match_id", "left").withColumn("_fix", F.coalesce(fix, F.lit(False)))
    return rows.select("match_id", F.when(F.col("_fix"), SUCCESS).otherwise(F.col("status")).alias("status"), F.when(F.col("_fix"), F.lit(now_ms)).otherwise(F.col("fetched_at")).alias("fetched_at"), F.col("_fix").alias("was_backfilled"))


def fold_fetch_attempts(attempts: DataFrame, now_ms: int, delays: list[int] = MATCH_DELAYS, most: int = MAX_MATCH_FAILURES, state: DataFrame | None = None, every: bool = False) -> DataFrame:
    """State of each match after its log of attempts (match_id, match_date, at,
    ok). Failures count since the last success, up to `most`, which is final,
    or all with `every`; the n-th waits delays[n - 1]. An earlier state (as returned) goes on; attempts up to
    its last one are in it."""
    if state is not None:
        then = state.select("match_id", F.col("last_attempt_at").alias("_then"))
        attempts = attempts.join(then, "match_id", "left").where("_then is null or at > _then").drop("_then")
    last = Window.partitionBy("match_id")
    rows = attempts.withColumn("_ok_at", F.max(F.when(F.col("ok"), F.col("at"))).over(last))
    failed = F.count_if(~F.col("ok") & (F.col("_ok_at").isNull() | (F.col("at") > F.col("_ok_at"))))
    got = rows.groupBy("match_id").agg(F.max("match_date").alias("match_date"), failed.alias("failures"), F.max("at").alias("last_attempt_at"), F.max("_ok_at").alias("last_success_at"))
    if state is not None:
        n, s = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"s.{c}"))
        kept = F.when(n("last_success_at").isNull(), F.coalesce(s("failures"), F.lit(0))).otherwise(0)
        got = got.alias("n").join(state.alias("s"), "match_id", "full").select("match_id", F.coalesce(n("match_date"), s("match_date")).alias("match_date"), (kept + F.coalesce(n("failures"), F.lit(0))).alias("failures"), *[F.coalesce(n(c), s(c)).alias(c) for c in ("last_attempt_at", "last_success_at")])
    if not every:
        got = got.withColumn("failures", F.least("failures", F.lit(most).cast("long")))
    old = F.lit(now_ms) - F.col("match_date") > RETENTION_DAYS * DAY
    status = F.when(old, OUTSIDE_RETENTION).when(F.col("failures") == 0, SUCCESS).when(F.col("failures") >= most, PERMANENT_FAILURE).otherwise(TEMPORARY_FAILURE)
    wait = F.get(F.array(*[F.lit(d) for d in delays]), F.least(F.col("failures"), F.lit(len(delays))).cast("int") - 1)
    return got.withColumn("status", status).withColumn("next_attempt_at", F.when(F.col("status") == TEMPORARY_FAILURE, F.col("last_attempt_at") + wait * 1000))


#: Status of a timeline that isn't wanted; the longest wait in
#: seconds; platforms that have a regional route.
NOT_APPLICABLE, MAX_TIMELINE_FAILURES, MAX_TIMELINE_DELAY = 4, 4, 300
ROUTED_PLATFORMS = ["BR1", "EUN1", "EUW1", "JP1", "KR", "LA1", "LA2", "ME1", "NA1", "OC1", "PBE1", "PH2", "RU", "SG2", "TH2", "TR1", "TW2", "VN2"]


def timeline_state(attempts: DataFrame, most: int = MAX_TIMELINE_FAILURES) -> DataFrame:
    """What a log of attempts (match_id, queue_id, at, ok) says of each match, in a
    bounded form that merges: match_id, queue_id, began, last, ok_at (the first
    success) and failed_at (the `most` earliest failures)."""
    nth = F.count_if(~F.col("ok")).over(Window.partitionBy("match_id").orderBy("at", "ok").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    early = F.when(~F.col("ok") & (F.col("_nth") <= most), F.col("at"))
    return attempts.withColumn("_nth", nth).groupBy("match_id").agg(F.max("queue_id").alias("queue_id"), F.min("at").alias("began"), F.max("at").alias("last"), F.min(F.when(F.col("ok"), F.col("at"))).alias("ok_at"), F.array_sort(F.collect_list(early)).alias("failed_at"))


def merged_timeline_states(states: list[DataFrame], most: int = MAX_TIMELINE_FAILURES) -> DataFrame:
    """The states of logs that have no attempt in common as the state of all of
    them, in any order and nesting."""
    rows = states[0]
    for other in states[1:]:
        rows = rows.unionByName(other)
    failed = F.slice(F.array_sort(F.flatten(F.collect_list("failed_at"))), 1, most)
    return rows.groupBy("match_id").agg(F.max("queue_id").alias("queue_id"), F.min("began").alias("began"), F.max("last").alias("last"), F.min("ok_at").alias("ok_at"), failed.alias("failed_at"))


def timeline_status(states: DataFrame, most: int = MAX_TIMELINE_FAILURES) -> DataFrame:
    """Status, retry count and next attempt of each state. Matches outside of ranked
    solo are not applicable; a match id whose platform has no route fails for good;
    the first success is final, so is the `most`-th failure before it; the n-th
    failure waits 30 seconds times 2^(n-1), 300 at most."""
    ranked = F.coalesce(F.col("queue_id") == RANKED_SOLO, F.lit(False))
    routed = match_platform(F.col("match_id")).isin(ROUTED_PLATFORMS)
    gone = F.get("failed_at", F.lit(most - 1))
    out = F.coalesce(gone.isNotNull() & (F.col("ok_at").isNull() | (gone < F.col("ok_at"))), F.lit(False))
    status = F.when(~ranked, NOT_APPLICABLE).when(~routed | out, PERMANENT_FAILURE).when(F.col("ok_at").isNotNull(), SUCCESS).otherwise(TEMPORARY_FAILURE)
    count = F.when(~ranked, 0).when(~routed | out, most).when(F.col("ok_at").isNotNull(), 0).otherwise(F.size("failed_at"))
    last = F.when(~ranked, F.col("last")).when(~routed, F.col("began")).when(out, gone).when(F.col("ok_at").isNotNull(), F.col("ok_at")).otherwise(F.col("last"))
    got = states.select("match_id", status.alias("status"), count.cast("int").alias("retry_count"), last.alias("last_attempt_at"))
    wait = F.least(F.lit(MAX_TIMELINE_DELAY), 30 * F.pow(F.lit(2), F.col("retry_count") - 1)).cast("long")
    return got.withColumn("next_attempt_at", F.when(F.col("status") == TEMPORARY_FAILURE, F.col("last_attempt_at") + wait * 1000))


def fold_timeline_attempts(attempts: DataFrame, most: int = MAX_TIMELINE_FAILURES, state: DataFrame | None = None) -> DataFrame:
    """Timeline status of each match after a log of attempts, which goes on behind
    an earlier state if there is one."""
    own = timeline_state(attempts, most)
    return timeline_status(own if state is None else merged_timeline_states([state, own], most), most)


def advance_cursors(cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """Backfill cursors after one run each: they only move back, stand still if
    the run stopped early or failed, and count runs that brought nothing.
    runs: puuid, scope, oldest_match_s, persisted, stopped_early, failed."""
    j = cursors.join(runs, ["puuid", "scope"], "full")
    ran = F.col("persisted").isNotNull()
    frozen = F.coalesce(F.col("stopped_early"), F.lit(False)) | F.coalesce(F.col("failed"), F.lit(False)) | F.col("oldest_match_s").isNull()
    to = F.greatest(F.lit(0), F.col("oldest_match_s") - 1)
    moved = F.when(~ran | frozen, F.col("before_epoch_s")).otherwise(F.least(F.coalesce("before_epoch_s", to), to))
    noop = F.when(~ran, F.coalesce("noop_runs", F.lit(0))).when(F.col("persisted") > 0, 0).otherwise(F.coalesce("noop_runs", F.lit(0)) + 1)
    return j.select("puuid", "scope", moved.alias("before_epoch_s"), noop.alias("noop_runs"), (F.coalesce("version", F.lit(0)) + F.when(ran, 1).otherwise(0)).alias("version"))


def name_dimension(entries: DataFrame, kind: str) -> DataFrame:
    """(kind, id, name) of a JSON object {key: {id, name}} in `body`; the key
    stands in for a missing id and `#id` for a missing name."""
    got = entries.select(F.explode(F.from_json("body", "map<string, struct<id: string, name: string>>")).alias("k", "v"))
    i = F.coalesce(F.col("v.id").try_cast("int"), F.col("k").try_cast("int"))
    return got.select(F.lit(kind).alias("kind"), i.alias("id"), F.coalesce(blank_to_null(F.col("v.name")), F.concat(F.lit("#"), i.cast("string"))).alias("name")).where("id is not null")


def rune_order(versions: DataFrame) -> DataFrame:
    """Display key of runes: slot times 100 plus place; shards from 1000 on."""
    place = F.row_number().over(Window.partitionBy("patch", "path_id", "slot").orderBy("rune_id")) - 1
    return versions.select("patch", "rune_id", "path_id", F.when(F.col("path_id") == SHARD_PATH, 1000 + F.col("slot") * 100 + place).otherwise(F.col("slot") * 100 + place).alias("order_key"))
