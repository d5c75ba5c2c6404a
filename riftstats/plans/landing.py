"""Registered queries of ingestion: conforming, upserts, repairs and streams.

Raw documents are rendered from the projections and parsed again, so each query
reads the whole tables and has a known answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources import raw as R
from ..sources.fixtures import Tables
from ..sources.versioned import VersionedTable
from ..streaming.matches import id_part
from .common import Query, folder, oracle, written

NOW = 901_929_600_000


def raw(t: Tables, schema: str = R.MATCH):
    """The whole documents of all matches, read with a schema."""
    return R.parse(R.documents(t.drafts, t.players), schema=schema)


def known(t: Tables):
    """All players but each 500th, who are unknown so far."""
    return t.summoners.where("summoner_id % 500 <> 7").select("puuid")


def held_runes(t: Tables):
    """The runes that participants hold in each patch."""
    return t.runes.select("patch", "rune_id").distinct()


def perks(t: Tables):
    """Perk documents of the held runes, some texts of which are missing."""
    r = F.col("rune_id")
    text = lambda name, n: F.when(r % n == 0, F.lit(" ")).when(r % n == 1, F.lit(None)).otherwise(F.concat(F.lit(f"{name} "), r))
    return held_runes(t).select("patch", "rune_id", F.concat(F.lit("k"), r).alias("key"), text("rune", 7).alias("name"), text("short", 3).alias("short_desc"), text("long", 4).alias("long_desc"), F.when(r % 5 != 0, F.concat(F.lit("tip "), r)).alias("tooltip"))


def perk_styles(t: Tables):
    """Style documents of each patch from the held runes: the slots of a style,
    then stat slots that each style repeats; each 11th rune is in none."""
    v = held_runes(t).where("rune_id % 11 <> 0").withColumn("path", F.when(F.col("rune_id") < 8000, 5000).otherwise(F.col("rune_id") - F.col("rune_id") % 100)).withColumn("row", F.when(F.col("rune_id") < 8000, F.floor((F.col("rune_id") - 5001) / 3)).otherwise(F.floor(F.col("rune_id") % 100 / 10)))
    rows = v.groupBy("patch", "path", "row").agg(F.array_sort(F.collect_list("rune_id")).alias("runes"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.struct("row", "runes"))), lambda s: F.struct(F.lit(kind).alias("kind"), s["runes"].alias("runes")))
    styles = rows.where("path <> 5000").groupBy("patch", "path").agg(listed("kMixedRegularSplashable").alias("slots"))
    stats = rows.where("path = 5000").groupBy("patch").agg(listed("KSTATMOD").alias("stats"))
    return styles.join(stats, "patch").select("patch", ((F.col("path") - 8000) / 100).cast("int").alias("place"), F.col("path").cast("int").alias("style_id"), F.concat(F.lit("path "), "path").alias("style_name"), F.concat("slots", "stats").alias("slots"))


def fresh_runes(t: Tables):
    return I.rune_versions(perks(t), perk_styles(t), t.spark.createDataFrame([], "rune_id int, patch string, key string, name string, description string, path_id int, path_name string, slot int"))


def rune_sides(t: Tables, now=None):
    """Current rows of all patches, of which some are missing, some differ and some
    are of runes that nobody holds; and the fresh ones."""
    r, now = F.col("rune_id"), fresh_runes(t) if now is None else now
    there = now.drop("change").where("rune_id % 3 <> 0").withColumn("name", F.when(r % 5 == 0, F.lit("old name")).otherwise(F.col("name")))
    gone = t.patches.select(F.lit(9999).alias("rune_id"), "patch", F.lit("k").alias("key"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.lit(0).alias("path_id"), F.lit(None).cast("string").alias("path_name"), F.lit(0).alias("slot"))
    return there.unionByName(gone), now


def rune_versions(t: Tables):
    return I.rune_versions(perks(t), perk_styles(t), rune_sides(t)[0])


def item_sides(t: Tables):
    """All patches, of each the known items that participants hold in it."""
    held = t.items.join(t.matches.select("match_id", "patch"), "match_id").select("patch", "item_id").distinct()
    v = t.item_versions.join(held, ["patch", "item_id"], "left_semi")
    dirty = v.select("item_id", "patch", F.when(F.col("in_store"), F.lit(None)).otherwise(F.lit(False)).alias("in_store"), F.when(F.col("price_total") > 0, F.col("price_total")).alias("price_total"), F.concat("builds_into", F.array(F.lit(0)), "builds_into").alias("builds_into"), F.concat("builds_from", F.array(F.lit(-1))).alias("builds_from"), F.concat(F.transform("tags", lambda x: F.concat(F.lit(" "), x)), F.array(F.lit("")), F.transform("tags", lambda x: F.upper(x))).alias("tags"))
    current = t.item_versions.where("item_id % 4 <> 0").withColumn("price_total", F.when(F.col("item_id") % 6 == 0, F.col("price_total") + 1).otherwise(F.col("price_total")))
    return dirty, current


def item_versions(t: Tables):
    got = I.item_versions(*item_sides(t))
    return got.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("builds_into", "builds_from", "tags")})


def renamed(df, only, prefix: str, key: str = "puuid"):
    """All rows, those that don't fulfil `only` under a key that the other side
    doesn't have."""
    return df.withColumn(key, F.when(F.expr(only), F.col(key)).otherwise(F.concat(F.lit(prefix), key)))


def current_ranks(t: Tables):
    return renamed(t.ranks, "wins % 3 <> 0", "C_")


def changed_ranks(t: Tables):
    return t.ranks.withColumn("league_points", F.col("league_points") + F.when(F.col("wins") % 4 == 0, 7).otherwise(0))


def incoming_ranks(t: Tables):
    return renamed(changed_ranks(t), "wins % 2 = 0", "N_")


def observed_ranks(t: Tables):
    """The incoming ranks, and of each fifth one two earlier observations."""
    fifth = changed_ranks(t).where("wins % 5 = 0")
    earlier = lambda n: fifth.withColumn("league_points", F.col("league_points") + 100 * n).withColumn("updated_at", F.col("updated_at") - n)
    return renamed(earlier(1).unionByName(earlier(2)), "wins % 2 = 0", "N_").unionByName(incoming_ranks(t))


def had_ranks(t: Tables):
    had = t.ranks.withColumn("losses", F.when(F.col("wins") % 8 == 0, F.col("losses")).otherwise(F.col("losses") + 1))
    return had.select(*I.RANK_KEY, *I.RANK_VALUES)


def rank_history(t: Tables):
    return I.rank_history(current_ranks(t), observed_ranks(t), had_ranks(t))


def summoner_sides(t: Tables):
    current = renamed(t.summoners, "summoner_id % 3 <> 0", "C_")
    incoming = t.summoners.withColumn("game_name", F.concat(F.lit("  "), "game_name", F.lit("2 "))).withColumn("updated_at", F.col("updated_at") + F.when(F.col("summoner_id") % 4 == 0, -1000).otherwise(1000))
    return current, renamed(incoming, "summoner_id % 2 = 0", "N_")


def upsert_summoners(t: Tables):
    return I.upsert_summoners(*summoner_sides(t), t.participants)


def by_puuid(t: Tables, at: str) -> VersionedTable:
    return VersionedTable(t.spark, at, F.pmod(F.xxhash64("puuid"), F.lit(8)))


def merged_twice(table: VersionedTable, current, incoming, keys: list[str], newest: str | None = None):
    """The table after the incoming rows, which are merged once more: nothing may
    change by that."""
    table.replace(current)
    table.merge(incoming, keys, newest)
    version = table.pointer()["version"]
    table.merge(incoming, keys, newest)
    if table.pointer()["version"] != version:
        raise RuntimeError("a second merge of the same rows has changed the table")
    return table.read()


def sink_rune_versions(t: Tables):
    kept, new = rune_sides(t, written(fresh_runes(t)))
    return merged_twice(VersionedTable(t.spark, folder(t.spark), F.col("patch")), kept, new.drop("change"), ["rune_id", "patch"])


def sink_item_versions(t: Tables):
    dirty, current = item_sides(t)
    # the few versions are written once: each look at them would derive all items of all matches again
    new = written(I.item_versions(dirty, current.where("false")).drop("change"))
    got = merged_twice(VersionedTable(t.spark, folder(t.spark), F.col("patch")), current.select(*new.columns), new, ["item_id", "patch"])
    return got.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("builds_into", "builds_from", "tags")})


def sink_ranks(t: Tables):
    """History first, then the ranks, so that a run that stops in between can start
    again; both once more change nothing."""
    at, state = folder(t.spark), [*I.RANK_KEY, *I.RANK_VALUES]
    ranks, history = by_puuid(t, f"{at}/ranks"), by_puuid(t, f"{at}/history")
    ranks.replace(current_ranks(t).select(*state))
    history.replace(had_ranks(t))
    seen = observed_ranks(t)
    incoming = I.last_of_each(seen, I.RANK_KEY, "updated_at").select(*state)
    for _ in range(2):
        names = ranks.names_in(incoming)
        history.merge(I.rank_history(ranks.read(names), seen, history.read(names)), state)
        ranks.merge(incoming, I.RANK_KEY)
        seen = incoming  # the run again, which knows the last states only
    both = ranks.read().withColumn("kind", F.lit("current")).unionByName(history.read().withColumn("kind", F.lit("history")))
    return both


def sink_summoners(t: Tables):
    current, incoming = summoner_sides(t)
    table = by_puuid(t, folder(t.spark))
    none = current.where("false")
    table.replace(I.upsert_summoners(current, none, none))
    mentioned = written(t.participants.select("puuid").distinct())
    for _ in range(2):
        names = table.names_in(incoming.select("puuid").unionByName(mentioned))
        changed = table.rewrite(I.upsert_summoners(table.read(names), incoming, mentioned))
    if changed:
        raise RuntimeError("a second run over the same rows has changed the table")
    return table.read()


def sink_timeline_snapshots(t: Tables):
    """Snapshots over earlier ones of the same marks, also of participants that
    aren't there any more, and of another mark, which stay."""
    new = I.timeline_snapshots(t.matches, t.participants, with_lost_puuids(t)).withColumn("part", id_part(F.col("match_id")))
    new = written(new)
    table = VersionedTable(t.spark, folder(t.spark), F.col("part"))
    stale = new.withColumn("gold", F.lit(-1).cast(new.schema["gold"].dataType))
    gone = stale.withColumn("participant_id", F.lit(99).cast(new.schema["participant_id"].dataType)).distinct()
    other = stale.withColumn("minute_mark", F.lit(10).cast(new.schema["minute_mark"].dataType))
    table.replace(stale.unionByName(gone).unionByName(other))
    for _ in range(2):
        changed = table.rewrite(I.replaced(table.read(table.names_in(new)), new, ["match_id", "minute_mark"], F.col("minute_mark") == 15))
    if changed:
        raise RuntimeError("a second run over the same rows has changed the table")
    return table.read().drop("part")


def sink_rune_selections(t: Tables):
    """All selections by patch, those of participants that had lost them repaired."""
    stored = t.runes.select("patch", "match_id", "participant_id", "rune_id", "tree", "idx", "style_id")
    table = VersionedTable(t.spark, folder(t.spark), F.col("patch"))
    table.replace(stored)
    for _ in range(2):
        rows = table.read()
        repaired = written(I.backfill_rune_selections(rows, t.rune_versions).join(rows.where(I.placeless()).select("match_id", "patch").distinct(), "match_id"))
        changed = table.rewrite(I.replaced(table.read(table.names_in(repaired)), repaired, ["match_id", "participant_id"], I.placeless()))
    if changed:
        raise RuntimeError("a second run over the same rows has changed the table")
    return table.read()


def match_sides(t: Tables):
    """Matches there and incoming: all rows, those that aren't to meet there under
    another id, those that aren't to be inserted in no queue."""
    there = renamed(t.matches, "match_key % 5 = 0", "OLD_", "match_id")
    queue = F.when(F.col("match_key") % 3 == 0, 0).otherwise(F.col("queue_id"))
    return there, t.matches.withColumn("queue_id", queue).select("match_id", "match_date", "patch", "queue_id", "queue_type")


def insert_new_matches(t: Tables):
    there, incoming = match_sides(t)
    return I.insert_new_matches(there, incoming.unionByName(incoming))


def versions(t: Tables):
    return t.matches.select(F.concat("patch", F.lit(".7.8")).alias("version"))


def with_lost_puuids(t: Tables):
    """Frames some of whose participant numbers are missing."""
    return t.frames.withColumn("participant_id", F.when(F.col("participant_id") % 4 == 0, F.lit(None)).otherwise(F.col("participant_id")))


def attempts(t: Tables):
    """A log of attempts: retry_count + 1 a match, the last one good if the match
    was fetched, the second good for each third match."""
    m = t.matches.where("match_date > 0").select("match_id", "match_key", (F.col("match_date") + 86_400_000 * 1000).alias("match_date"), "status", "retry_count", F.explode(F.sequence(F.lit(0), F.col("retry_count"))).alias("n"))
    ok = ((F.col("n") == F.col("retry_count")) & (F.col("status") == 1)) | ((F.col("n") == 1) & (F.col("match_key") % 3 == 0))
    return m.select("match_id", "match_date", (F.col("match_date") + F.col("n") * 60_000).alias("at"), ok.alias("ok"))


def timeline_attempts(t: Tables):
    """The same log with the queue, some matches on a platform without a route."""
    n = F.col("match_key")
    m = t.matches.select("match_key", F.concat(F.when(n % 17 == 0, "XX9_").otherwise("na1_"), n.cast("string")).alias("match_id"), "match_date", "queue_id", "status", "retry_count", F.explode(F.sequence(F.lit(0), F.col("retry_count"))).alias("n"))
    ok = ((F.col("n") == F.col("retry_count")) & (F.col("status") == 1)) | ((F.col("n") == 1) & (n % 3 == 0))
    return m.select("match_id", "queue_id", (F.col("match_date") + F.col("n") * 60_000).alias("at"), ok.alias("ok"))


def merged_timeline_logs(t: Tables):
    """The state of a log that came in three parts, folded apart and merged."""
    log = timeline_attempts(t)
    parts = [I.timeline_state(log.where(F.col("at") % 3 == k)) for k in (2, 0, 1)]
    return I.timeline_status(I.merged_timeline_states([I.merged_timeline_states(parts[:2]), parts[2]]))


def cursors(t: Tables):
    return t.summoners.where("summoner_id % 4 <> 0").select("puuid", F.lit("history").alias("scope"), F.when(F.col("summoner_id") % 5 != 0, F.lit(800_000_000)).cast("long").alias("before_epoch_s"), (F.col("summoner_id") % 3).cast("int").alias("noop_runs"), F.lit(1).alias("version"))


def runs(t: Tables):
    rows = t.participants.join(t.matches.where("status <> 3").select("match_id", "match_date", "status"), "match_id")
    n = F.regexp_replace("puuid", "P_", "").cast("int")
    got = rows.groupBy("puuid").agg(F.floor(F.min("match_date") / 1000).alias("oldest_match_s"), F.count_if(F.col("status") == 0).alias("persisted"))
    return got.where(n % 3 != 1).select("puuid", F.lit("history").alias("scope"), "oldest_match_s", "persisted", (n % 11 == 0).alias("stopped_early"), (n % 13 == 0).alias("failed"))


def names(t: Tables):
    """Name documents of champions (by summoner number) and items."""
    c = t.participants.select("champion_id").distinct().select(F.lit("champion").alias("kind"), F.col("champion_id").alias("i"))
    i = t.items.select("item_id").distinct().select(F.lit("item").alias("kind"), F.col("item_id").alias("i"))
    entry = F.struct(F.when(F.col("i") % 3 != 0, F.col("i").cast("string")).alias("id"), F.when(F.col("i") % 7 == 0, F.lit(" ")).otherwise(F.concat("kind", F.lit(" "), "i")).alias("name"))
    docs = c.unionByName(i).groupBy("kind").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("string"), entry)))).alias("body"))
    return I.name_dimension(docs.where("kind = 'champion'"), "champion").unionByName(I.name_dimension(docs.where("kind = 'item'"), "item"))


FACTS = "p.match_id, m.match_date, m.duration, m.patch, m.queue_id, p.participant_id, p.puuid, p.team_id, p.champion_id, nullif(p.team_position, '') AS team_position, p.win, p.kills, p.deaths, p.assists, p.champ_level, p.gold_earned, p.damage, p.vision_score, p.minions, p.neutral, p.champion_id % 12 + 1 AS spell1, 4 AS spell2, 'GameComplete' AS end_of_game_result"
BLANK = "(p.match_key % 71 = 0 AND p.participant_id = 1)"
UNKNOWN = "(cast(replace(p.puuid, 'P_', '') as int) % 500 = 7)"
TABLES = ("participants", "matches")


def without_change(name: str) -> str:
    return f"SELECT * EXCLUDE (change) FROM ({QUERIES[name][1]})"


#: The states of each rank in their order, and those that history gets.
RANKS_SQL = """obs AS (SELECT CASE WHEN wins % 3 = 0 THEN 'C_' ELSE '' END || puuid AS puuid, queue_type, tier, division, league_points, wins, losses, 0 AS n FROM ranks
    UNION ALL SELECT CASE WHEN wins % 2 = 1 THEN 'N_' ELSE '' END || puuid, queue_type, tier, division, league_points + CASE WHEN wins % 4 = 0 THEN 7 ELSE 0 END + CASE WHEN k < 3 THEN 100 * (3 - k) ELSE 0 END, wins, losses, k FROM ranks, (SELECT unnest([1, 2, 3]) AS k) WHERE k = 3 OR wins % 5 = 0),
  sq AS (SELECT *, lead(league_points) OVER (PARTITION BY puuid, queue_type ORDER BY n) AS nxt FROM obs),
  hi AS (SELECT DISTINCT puuid, queue_type, tier, division, league_points, wins, losses FROM sq WHERE nxt <> league_points
    EXCEPT SELECT puuid, queue_type, tier, division, league_points, wins, CASE WHEN wins % 8 = 0 THEN losses ELSE losses + 1 END FROM ranks)"""
QUERIES: dict[str, Query] = {
    "match_facts": (lambda t: I.match_facts(raw(t, R.FACTS_READ), known(t)), oracle(TABLES, f"bad AS (SELECT DISTINCT match_id FROM participants p WHERE {BLANK} OR {UNKNOWN}) SELECT {FACTS}, false AS is_stub FROM participants p JOIN matches m ON p.match_id = m.match_id WHERE p.match_id NOT IN (SELECT match_id FROM bad)")),
    "match_facts_lenient": (lambda t: I.match_facts(raw(t, R.FACTS_READ), known(t), "lenient"), oracle(TABLES, f"one AS (SELECT 1) SELECT {FACTS}, {UNKNOWN} AS is_stub FROM participants p JOIN matches m ON p.match_id = m.match_id WHERE NOT {BLANK}")),
    "participant_runes": (
        lambda t: I.participant_runes(raw(t, R.RUNES_READ)),
        oracle(("runes",), "sty AS (SELECT match_id, participant_id, tree_kind, max(style_id) AS style_id FROM runes GROUP BY 1, 2, 3) SELECT r.match_id, r.participant_id, r.tree_kind AS tree, row_number() OVER (PARTITION BY r.match_id, r.participant_id, r.tree_kind ORDER BY r.rune_id) - 1 AS idx, r.rune_id, CASE WHEN r.tree_kind = 2 THEN 0 ELSE s.style_id END AS style_id FROM runes r JOIN sty s ON r.match_id = s.match_id AND r.participant_id = s.participant_id AND r.tree_kind = s.tree_kind"),
    ),
    "participant_items": (lambda t: I.participant_items(raw(t, R.ITEMS_READ)), oracle(("items",), "one AS (SELECT 1) SELECT match_id, participant_id, slot, item_id FROM items")),
    "match_bans": (lambda t: I.match_bans(raw(t, R.BANS_READ)), oracle((*TABLES, "bans"), "one AS (SELECT 1) SELECT match_id, team_id, pick_turn, champion_id FROM bans WHERE match_id IN (SELECT match_id FROM participants)")),
    "conform_queue": (
        lambda t: I.conform_queue(t.matches),
        oracle(("matches",), "q AS (SELECT match_id, CASE WHEN queue_id <> 0 THEN queue_id ELSE coalesce(try_cast(queue_type AS int), 0) END AS queue_id FROM matches) SELECT match_id, queue_id, CASE queue_id WHEN 420 THEN 'RANKED_SOLO_DUO' WHEN 440 THEN 'RANKED_FLEX' ELSE 'ARAM' END AS queue_family, CASE queue_id WHEN 420 THEN 'Ranked Solo/Duo' WHEN 440 THEN 'Ranked Flex' ELSE 'ARAM' END AS queue_label FROM q"),
    ),
    "patch_dimension": (
        lambda t: I.patch_dimension(versions(t), t.matches, t.patches.where("patch not in ('8.1', '5.2')"), NOW),
        oracle(("matches", "patches"), f"one AS (SELECT 1) SELECT patch, CASE WHEN patch IN ('8.1', '5.2') THEN {NOW} ELSE released_at END AS released_at, patch = (SELECT arg_max(patch, cast(split_part(patch, '.', 1) as int) * 100 + cast(split_part(patch, '.', 2) as int)) FROM patches) AS is_active FROM patches"),
    ),
    "rune_versions": (
        rune_versions,
        oracle(("runes", "patches"), """hd AS (SELECT DISTINCT patch, rune_id FROM runes), now AS (SELECT rune_id, patch, 'k' || rune_id AS key, CASE WHEN rune_id % 7 < 2 THEN 'Rune ' || rune_id ELSE 'rune ' || rune_id END AS name,
            CASE WHEN rune_id % 3 = 2 THEN 'short ' || rune_id WHEN rune_id % 4 > 1 THEN 'long ' || rune_id WHEN rune_id % 5 <> 0 THEN 'tip ' || rune_id ELSE '' END AS description, rune_id % 11 = 0 AS lost,
            CASE WHEN rune_id % 11 = 0 THEN 0 WHEN rune_id < 8000 THEN 5000 ELSE rune_id - rune_id % 100 END AS path_id, CASE WHEN rune_id < 8000 THEN (rune_id - 5001) // 3 ELSE rune_id % 100 // 10 END AS row FROM hd),
          sl AS (SELECT patch, path_id, row, row_number() OVER (PARTITION BY patch, path_id ORDER BY row) - 1 AS slot FROM (SELECT DISTINCT patch, path_id, row FROM now WHERE NOT lost)),
          new AS (SELECT n.rune_id, n.patch, n.key, n.name, n.description, n.path_id, CASE WHEN n.path_id = 5000 THEN 'Stat Mods' WHEN n.path_id > 0 THEN 'path ' || n.path_id END AS path_name, CASE WHEN lost THEN 0 ELSE s.slot END AS slot FROM now n LEFT JOIN sl s ON n.patch = s.patch AND n.path_id = s.path_id AND n.row = s.row AND NOT lost)
          SELECT *, CASE WHEN rune_id % 3 = 0 THEN 'inserted' WHEN rune_id % 5 = 0 THEN 'updated' ELSE 'same' END AS change FROM new UNION ALL SELECT 9999, patch, 'k', 'n', 'd', 0, NULL, 0, 'kept' FROM patches"""),
    ),
    "item_versions": (
        item_versions,
        oracle(("item_versions", "items", "matches"), """hd AS (SELECT DISTINCT m.patch, i.item_id FROM items i JOIN matches m ON i.match_id = m.match_id), now AS (SELECT v.* FROM item_versions v WHERE (v.patch, v.item_id) IN (SELECT (patch, item_id) FROM hd)), cur AS (SELECT item_id, patch, in_store, CASE WHEN item_id % 6 = 0 THEN price_total + 1 ELSE price_total END AS price_total, builds_into, builds_from, tags FROM item_versions WHERE item_id % 4 <> 0)
          SELECT coalesce(n.item_id, c.item_id) AS item_id, coalesce(n.patch, c.patch) AS patch, coalesce(n.in_store, c.in_store) AS in_store, coalesce(n.price_total, c.price_total) AS price_total, array_to_string(coalesce(n.builds_into, c.builds_into), ',') AS builds_into, array_to_string(coalesce(n.builds_from, c.builds_from), ',') AS builds_from, array_to_string(coalesce(n.tags, c.tags), ',') AS tags,
            CASE WHEN c.item_id IS NULL THEN 'inserted' WHEN n.item_id IS NULL THEN 'kept' WHEN n.price_total = c.price_total THEN 'same' ELSE 'updated' END AS change FROM now n FULL JOIN cur c ON n.item_id = c.item_id AND n.patch = c.patch"""),
    ),
    "upsert_summoners": (
        upsert_summoners,
        oracle(("summoners", "participants", "matches"), """bo AS (SELECT CASE WHEN summoner_id % 3 = 0 THEN 'C_' ELSE '' END || puuid AS puuid, game_name, tag_line, platform_region, updated_at FROM summoners UNION ALL SELECT CASE WHEN summoner_id % 2 = 1 THEN 'N_' ELSE '' END || puuid, game_name || '2', tag_line, platform_region, updated_at + CASE WHEN summoner_id % 4 = 0 THEN -1000 ELSE 1000 END FROM summoners),
          nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY puuid ORDER BY updated_at DESC) AS n FROM bo) WHERE n = 1)
          SELECT puuid, game_name, tag_line, platform_region, updated_at, false AS is_stub, upper(game_name) AS name_key, upper(tag_line) AS tag_key FROM nw UNION ALL SELECT DISTINCT puuid, NULL, NULL, NULL, 0, true, NULL, NULL FROM participants WHERE puuid NOT IN (SELECT puuid FROM nw)"""),
    ),
    "upsert_ranks": (
        lambda t: I.upsert_ranks(current_ranks(t), observed_ranks(t)),
        oracle(("ranks",), """cur AS (SELECT * REPLACE (CASE WHEN wins % 3 = 0 THEN 'C_' ELSE '' END || puuid AS puuid) FROM ranks), inc AS (SELECT * REPLACE (CASE WHEN wins % 2 = 1 THEN 'N_' ELSE '' END || puuid AS puuid, league_points + CASE WHEN wins % 4 = 0 THEN 7 ELSE 0 END AS league_points) FROM ranks)
          SELECT coalesce(i.puuid, c.puuid) AS puuid, coalesce(i.queue_type, c.queue_type) AS queue_type, coalesce(i.tier, c.tier) AS tier, coalesce(i.division, c.division) AS division, coalesce(i.league_points, c.league_points) AS league_points, coalesce(i.wins, c.wins) AS wins, coalesce(i.losses, c.losses) AS losses, CASE WHEN c.puuid IS NULL THEN 'inserted' WHEN i.puuid IS NULL THEN 'kept' WHEN i.league_points = c.league_points THEN 'same' ELSE 'updated' END AS change FROM cur c FULL JOIN inc i ON c.puuid = i.puuid AND c.queue_type = i.queue_type"""),
    ),
    "rank_history": (rank_history, oracle(("ranks",), RANKS_SQL + " SELECT * FROM hi")),
    "insert_new_matches": (insert_new_matches, oracle(("matches",), "one AS (SELECT 1) SELECT match_id, match_date, patch, queue_id, queue_type FROM matches WHERE match_key % 3 <> 0 AND match_key % 5 <> 0 AND queue_id <> 0")),
    "timeline_snapshots": (
        lambda t: I.timeline_snapshots(t.matches, t.participants, with_lost_puuids(t)),
        oracle((*TABLES, "frames"), """ch AS (SELECT match_id, coalesce(max(timestamp_ms) FILTER (WHERE timestamp_ms <= 900000), min(timestamp_ms)) AS ts FROM frames GROUP BY 1)
          SELECT f.match_id, f.participant_id, 15 AS minute_mark, f.total_gold AS gold, f.xp, f.cs, f.level, f.timestamp_ms, CASE WHEN ts > 900000 THEN 'AFTER_TARGET' WHEN ts = 900000 THEN 'EXACT' ELSE 'PRIOR_FRAME' END || CASE WHEN m.duration < 900 THEN '|SHORT_GAME' ELSE '' END AS quality_flags FROM frames f JOIN ch ON f.match_id = ch.match_id AND f.timestamp_ms = ch.ts JOIN matches m ON m.match_id = f.match_id"""),
    ),
    "backfill_rune_selections": (
        lambda t: I.backfill_rune_selections(t.runes, t.rune_versions),
        oracle(("runes",), "one AS (SELECT 1) SELECT match_id, participant_id, rune_id, 2 AS tree, row_number() OVER (PARTITION BY match_id, participant_id ORDER BY CASE WHEN rune_id < 8000 THEN rune_id - 5001 ELSE (rune_id % 100) // 10 END, rune_id) - 1 AS idx, 0 AS style_id FROM runes WHERE match_key % 19 = 0"),
    ),
    "backfill_match_status": (
        lambda t: I.backfill_match_status(t.matches, t.participants, NOW),
        oracle(TABLES, f"hv AS (SELECT *, status = 0 AND match_id IN (SELECT match_id FROM participants) AS fix FROM matches) SELECT match_id, CASE WHEN fix THEN 1 ELSE status END AS status, CASE WHEN fix THEN {NOW} ELSE fetched_at END AS fetched_at, fix AS was_backfilled FROM hv"),
    ),
    "fold_fetch_attempts": (
        lambda t: I.fold_fetch_attempts(attempts(t), 978_307_200_000, every=True),
        oracle(("matches",), """lg AS (SELECT match_id, match_date + 86400000000 AS match_date, match_key, status, retry_count, unnest(range(0, retry_count + 1)) AS n FROM matches),
          lo AS (SELECT *, match_date + n * 60000 AS tried, (n = retry_count AND status = 1) OR (n = 1 AND match_key % 3 = 0) AS ok FROM lg), ls AS (SELECT *, max(tried) FILTER (WHERE ok) OVER (PARTITION BY match_id) AS ok_at FROM lo),
          fo AS (SELECT match_id, max(match_date) AS match_date, count(*) FILTER (WHERE NOT ok AND (ok_at IS NULL OR tried > ok_at)) AS failures, max(tried) AS last_attempt_at, max(ok_at) AS last_success_at FROM ls GROUP BY 1),
          st AS (SELECT *, CASE WHEN 978307200000 - match_date > 63072000000 THEN 4 WHEN failures = 0 THEN 1 WHEN failures >= 5 THEN 3 ELSE 2 END AS status FROM fo)
          SELECT *, CASE WHEN status = 2 THEN last_attempt_at + 1000 * CASE failures WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 120 ELSE 300 END END AS next_attempt_at FROM st"""),
    ),
    "fold_timeline_attempts": (
        lambda t: I.fold_timeline_attempts(timeline_attempts(t)),
        oracle(("matches",), """lg AS (SELECT match_key, CASE WHEN match_key % 17 = 0 THEN 'XX9_' ELSE 'na1_' END || match_key AS match_id, match_date, queue_id, status, retry_count, unnest(range(0, retry_count + 1)) AS n FROM matches),
          lo AS (SELECT *, match_date + n * 60000 AS tried, (n = retry_count AND status = 1) OR (n = 1 AND match_key % 3 = 0) AS ok FROM lg),
          fo AS (SELECT match_id, max(queue_id) AS queue_id, max(match_key) AS match_key, max(match_date) AS t0, max(tried) AS last, min(n) FILTER (WHERE ok) AS ok_n, max(n) AS last_n FROM lo GROUP BY 1),
          st AS (SELECT *, CASE WHEN queue_id <> 420 THEN 4 WHEN match_key % 17 = 0 THEN 3 WHEN coalesce(ok_n, last_n + 1) >= 4 THEN 3 WHEN ok_n IS NOT NULL THEN 1 ELSE 2 END AS status FROM fo),
          rt AS (SELECT match_id, status, cast(CASE status WHEN 4 THEN 0 WHEN 3 THEN 4 WHEN 1 THEN 0 ELSE last_n + 1 END AS int) AS retry_count, CASE WHEN status = 4 THEN last WHEN match_key % 17 = 0 THEN t0 WHEN status = 3 THEN t0 + 180000 WHEN status = 1 THEN t0 + ok_n * 60000 ELSE last END AS last_attempt_at FROM st)
          SELECT *, CASE WHEN status = 2 THEN last_attempt_at + 1000 * least(300, 30 * (1 << (retry_count - 1))) END AS next_attempt_at FROM rt"""),
    ),
    "advance_cursors": (
        lambda t: I.advance_cursors(cursors(t), runs(t)),
        oracle((*TABLES, "summoners"), """cu AS (SELECT puuid, CASE WHEN summoner_id % 5 <> 0 THEN 800000000 END AS b, summoner_id % 3 AS noop FROM summoners WHERE summoner_id % 4 <> 0),
          ru AS (SELECT *, cast(replace(puuid, 'P_', '') as int) AS n FROM (SELECT p.puuid, min(m.match_date) // 1000 AS oldest, count(*) FILTER (WHERE m.status = 0) AS persisted FROM participants p JOIN matches m ON p.match_id = m.match_id WHERE m.status <> 3 GROUP BY 1))
          SELECT coalesce(c.puuid, r.puuid) AS puuid, 'history' AS scope, CASE WHEN r.puuid IS NULL OR r.n % 11 = 0 OR r.n % 13 = 0 THEN c.b ELSE least(coalesce(c.b, greatest(0, r.oldest - 1)), greatest(0, r.oldest - 1)) END AS before_epoch_s,
            CASE WHEN r.puuid IS NULL THEN c.noop WHEN r.persisted > 0 THEN 0 ELSE coalesce(c.noop, 0) + 1 END AS noop_runs, CASE WHEN c.puuid IS NULL THEN 0 ELSE 1 END + CASE WHEN r.puuid IS NULL THEN 0 ELSE 1 END AS version FROM cu c FULL JOIN (SELECT * FROM ru WHERE n % 3 <> 1) r ON c.puuid = r.puuid"""),
    ),
    "name_dimensions": (
        names,
        oracle((*TABLES, "items"), "nm AS (SELECT 'champion' AS kind, champion_id AS id FROM participants UNION SELECT 'item', item_id FROM items) SELECT kind, id, CASE WHEN id % 7 = 0 THEN '#' || cast(id as string) ELSE kind || ' ' || cast(id as string) END AS name FROM nm"),
    ),
    "rune_order": (
        lambda t: I.rune_order(t.rune_versions.join(held_runes(t), ["patch", "rune_id"], "left_semi")),
        oracle(("rune_versions", "runes"), "held AS (SELECT * FROM rune_versions WHERE (patch, rune_id) IN (SELECT (patch, rune_id) FROM runes)) SELECT patch, rune_id, path_id, CASE WHEN path_id = 5000 THEN 1000 ELSE 0 END + slot * 100 + row_number() OVER (PARTITION BY patch, path_id, slot ORDER BY rune_id) - 1 AS order_key FROM held"),
    ),
}
QUERIES |= {
    "sink_rune_versions": (sink_rune_versions, without_change("rune_versions")),
    "sink_item_versions": (sink_item_versions, without_change("item_versions")),
    "sink_summoners": (sink_summoners, QUERIES["upsert_summoners"][1]),
    "sink_ranks": (
        sink_ranks,
        oracle(("ranks",), RANKS_SQL + """, al AS (SELECT puuid, queue_type, tier, division, league_points, wins, losses, 'current' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY puuid, queue_type ORDER BY n DESC) AS back FROM obs) WHERE back = 1
          UNION ALL SELECT *, 'history' FROM hi UNION ALL SELECT puuid, queue_type, tier, division, league_points, wins, CASE WHEN wins % 8 = 0 THEN losses ELSE losses + 1 END, 'history' FROM ranks) SELECT * FROM al"""),
    ),
    "sink_timeline_snapshots": (
        sink_timeline_snapshots,
        f"SELECT * FROM ({QUERIES['timeline_snapshots'][1]}) UNION ALL SELECT match_id, participant_id, 10, -1, xp, cs, level, timestamp_ms, quality_flags FROM ({QUERIES['timeline_snapshots'][1]})",
    ),
    "sink_rune_selections": (
        sink_rune_selections,
        oracle(("runes",), f"rp AS ({QUERIES['backfill_rune_selections'][1]}), al AS (SELECT patch, match_id, participant_id, rune_id, tree, idx, style_id FROM runes WHERE match_key % 19 <> 0 UNION ALL SELECT x.patch, rp.match_id, rp.participant_id, rp.rune_id, rp.tree, rp.idx, rp.style_id FROM rp JOIN (SELECT DISTINCT match_id, patch FROM runes) x ON rp.match_id = x.match_id) SELECT * FROM al"),
    ),
    "merged_timeline_logs": (merged_timeline_logs, QUERIES["fold_timeline_attempts"][1]),
}
#: The names that the queries over all rows had beside those over some.
QUERIES |= {"upsert_all_summoners": QUERIES["upsert_summoners"], "upsert_all_ranks": QUERIES["upsert_ranks"]}
