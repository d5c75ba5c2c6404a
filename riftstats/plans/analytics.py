"""Registered queries of champion analytics, each with its DuckDB oracle."""

from __future__ import annotations

from ..operators import champions as C
from ..operators.ingest import timeline_snapshots
from ..sources.fixtures import Tables
from ..sources.versioned import VersionedTable
from .common import EFF, GRADE, RANKED, SOLO, Query, folder, oracle, rounded

RR, MORE = ("participants", "matches"), ("participants", "matches", "bans", "ranks")
MIN, EARLY_MIN = 45, 20
#: A day after the release of patch 8.1, whose first days the early minimum is for.
EARLY_NOW = 883_699_200_000
EARLY = f"(SELECT CASE WHEN {EARLY_NOW} < q.released_at + 259200000 THEN {EARLY_MIN} ELSE {MIN} END FROM patches q WHERE q.patch = {{0}}.patch)"


def snapshots(t: Tables):
    """Snapshots at minute 15 with a derivation time a day after the match."""
    from pyspark.sql import functions as F

    s = timeline_snapshots(t.matches, t.participants, t.frames)
    return s.join(t.matches.select("match_id", (F.col("match_date") + 86_400_000).alias("derived_at")), "match_id")


def tiers(t: Tables, role: str = "ALL", scope: str | None = None, minimum: int | C.Sample = MIN):
    return C.tier_list(t.matches, t.participants, t.bans, t.ranks, role, scope, minimum)


def early(t: Tables) -> C.Sample:
    return C.Sample(MIN, EARLY_MIN, 72, t.patches, EARLY_NOW)


def role_tiers(t: Tables):
    return C.tier_lists_by_role(t.matches, t.participants, t.bans, t.ranks, None, MIN)


def winrates(t: Tables, minimum: int | C.Sample = MIN, region: str | None = None):
    return C.champion_winrates(t.matches, t.participants, t.bans, t.ranks, minimum, None, t.summoners, region)


def matchups(t: Tables):
    return C.lane_matchups(t.matches, t.participants, snapshots(t), None, None, 30)


def pro(t: Tables):
    return t.matches, t.participants, t.pro_roster, t.summoners


def incremental_grid(t: Tables):
    """The grid from a mart that got the matches in three batches, one of them twice."""
    from pyspark.sql import functions as F

    mart = VersionedTable(t.spark, folder(t.spark), F.col("patch"))
    for n in (0, 1, 1, 2):
        C.refresh_grid(mart, t.matches.where(F.pmod("match_key", F.lit(3)) == n), t.participants, t.bans, t.ranks, n)
    return C.scores_of(mart.read(), MIN)


def frequency(t: Tables):
    return C.item_frequency(t.matches, t.participants, t.items, t.item_versions)


SNAP = """snap AS (
  SELECT f.match_id, f.participant_id, f.total_gold AS gold, f.xp, f.cs, f.level, f.timestamp_ms, c.missed, m.duration, m.match_date + 86400000 AS derived_at
  FROM frames f JOIN (SELECT match_id, coalesce(max(timestamp_ms) FILTER (WHERE timestamp_ms <= 900000), min(timestamp_ms)) AS ts, max(timestamp_ms) FILTER (WHERE timestamp_ms <= 900000) IS NULL AS missed FROM frames GROUP BY match_id) c
  ON f.match_id = c.match_id AND f.timestamp_ms = c.ts JOIN matches m ON m.match_id = f.match_id)"""


def tier_ctes(keys: str, source: str, conf: int | str = MIN) -> str:
    """CTEs up to `graded` for rows `source`(keys, match_id, champion_id, win)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""src AS ({source}),
    tot AS (SELECT {keys}, count(*) AS n, count(DISTINCT match_id) AS nm FROM src GROUP BY {keys}),
    ban AS (SELECT {keys}, b2.champion_id, count(DISTINCT a2.match_id) AS nb FROM (SELECT DISTINCT {keys}, match_id FROM src) a2 JOIN bans b2 ON a2.match_id = b2.match_id GROUP BY {keys}, b2.champion_id),
    grp AS (SELECT a.*, b.n, b.nm, a.games >= {EFF(conf, "b.n", 5)} AS ok FROM (SELECT {keys}, champion_id, count(*) AS games, count(*) FILTER (WHERE win) AS wins FROM src GROUP BY {keys}, champion_id) a JOIN tot b ON {on}),
    kept AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY {keys}) AS anyok FROM grp) WHERE ok OR NOT anyok),
    scored AS (SELECT a.*, coalesce(b.nb, 0) / a.nm AS ban_rate, wins / games AS win_rate, games / n AS pick_rate,
      round(0.7 * greatest(0.0, (wins / games + 3.8416 / (2 * games) - 1.96 * sqrt((wins / games * (1 - wins / games) + 3.8416 / (4 * games)) / games)) / (1 + 3.8416 / games)) + 0.3 * games / n, 12) AS score
      FROM kept a LEFT JOIN ban b ON {on} AND a.champion_id = b.champion_id),
    graded AS (SELECT *, {GRADE("(place - 1) / cnt")} AS grade FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, champion_id) AS place, count(*) OVER (PARTITION BY {keys}) AS cnt FROM scored))"""


ALL_ROLES = "SELECT patch, 'ALL' AS role, match_id, champion_id, win FROM rr"
EACH_ROLE = "SELECT patch, team_position AS role, match_id, champion_id, win FROM rr"
TIER_COLS = "patch, role, champion_id, games, round(win_rate, 6) AS win_rate, round(pick_rate, 6) AS pick_rate, round(ban_rate, 6) AS ban_rate, round(score, 6) AS score, place, grade"

KOREA = "(SELECT puuid FROM summoners WHERE platform_region = 'KR')"
ASIA = "(SELECT puuid FROM summoners WHERE region = 'ASIA')"


def ranked_in(players: str) -> str:
    return f"{RANKED.replace('rr AS', 'rr0 AS')}, rr AS (SELECT * FROM rr0 WHERE puuid IN {players})"


def winrates_sql(conf: int | str = MIN) -> str:
    return f"""wr0 AS (SELECT r.*, coalesce(s.tier, 'UNRANKED') AS rank_tier, b.match_id IS NOT NULL AS banned FROM rr r LEFT JOIN solo s ON r.puuid = s.puuid LEFT JOIN (SELECT DISTINCT match_id, champion_id FROM bans) b ON b.match_id = r.match_id AND b.champion_id = r.champion_id),
  wr1 AS (SELECT *, sum(games) OVER (PARTITION BY patch, champion_id) AS total FROM (SELECT patch, champion_id, team_position AS role, rank_tier, count(*) AS games, count(*) FILTER (WHERE win) AS wins, count(DISTINCT match_id) AS gm, count(DISTINCT match_id) FILTER (WHERE banned) AS bm FROM wr0 GROUP BY ALL)),
  wr2 AS (SELECT *, bool_or(ok) OVER (PARTITION BY patch, champion_id) AS anyok FROM (SELECT *, games >= {EFF(conf, "total", 3)} AS ok FROM wr1)),
  rrank AS (SELECT *, row_number() OVER (PARTITION BY patch, role, rank_tier ORDER BY wins / games DESC, games DESC, champion_id) AS role_rank, count(*) OVER (PARTITION BY patch, role, rank_tier) AS role_population FROM wr1 WHERE rank_tier <> 'UNRANKED'),
  wr AS (SELECT a.patch, a.champion_id, a.role, a.rank_tier, a.games, a.wins, a.wins / a.games AS win_rate, a.games / a.total AS pick_rate, a.bm / a.gm AS ban_rate, b.role_rank, b.role_population FROM wr2 a LEFT JOIN rrank b ON a.patch = b.patch AND a.role = b.role AND a.rank_tier = b.rank_tier AND a.champion_id = b.champion_id WHERE a.ok OR NOT a.anyok)"""


WINRATES = winrates_sql()
WR_COLS = "patch, champion_id, role, rank_tier, games, wins, round(win_rate, 6) AS win_rate, round(pick_rate, 6) AS pick_rate, round(ban_rate, 6) AS ban_rate, role_rank, role_population"
MU_COLS = "patch, champion_id, role, opponent_id, games, wins, losses, round(win_rate, 6) AS win_rate, timeline_games, round(gold_diff, 6) AS gold_diff, round(xp_diff, 6) AS xp_diff, derived_at"
MATCHUPS = f"""{SNAP},
  mu1 AS (SELECT a.patch, a.champion_id, a.team_position AS role, b.champion_id AS opponent_id, count(*) AS games, count(*) FILTER (WHERE a.win) AS wins, count(*) FILTER (WHERE sa.gold IS NOT NULL AND sb.gold IS NOT NULL) AS timeline_games, avg(sa.gold - sb.gold) AS gold_diff, avg(sa.xp - sb.xp) AS xp_diff, max(sa.derived_at) AS derived_at
    FROM rr a JOIN rr b ON a.match_id = b.match_id AND a.team_position = b.team_position AND a.team_id <> b.team_id LEFT JOIN snap sa ON sa.match_id = a.match_id AND sa.participant_id = a.participant_id LEFT JOIN snap sb ON sb.match_id = b.match_id AND sb.participant_id = b.participant_id GROUP BY 1, 2, 3, 4),
  mu2 AS (SELECT *, games >= {EFF(30, "total", 2)} AS ok FROM (SELECT *, sum(games) OVER (PARTITION BY patch, champion_id, role) AS total FROM mu1)),
  mu AS (SELECT *, games - wins AS losses, wins / games AS win_rate FROM (SELECT *, bool_or(ok) OVER (PARTITION BY patch, champion_id, role) AS anyok FROM mu2) WHERE ok OR NOT anyok)"""

EXCLUDED = ", ".join(map(str, C.EXCLUDED_ITEMS))
BUILT = f"""bi0 AS (SELECT r.patch, r.champion_id, r.team_position AS role, r.match_id, r.participant_id, r.win, i.item_id, v.item_id IS NOT NULL AS known, coalesce(v.in_store AND v.price_total > 0 AND len(v.builds_into) = 0 AND len(v.builds_from) > 0 AND NOT list_has_any(v.tags, ['Consumable', 'Trinket', 'Vision']), false) AS built
    FROM rr r JOIN items i ON r.match_id = i.match_id AND r.participant_id = i.participant_id LEFT JOIN item_versions v ON v.item_id = i.item_id AND v.patch = r.patch),
  cover AS (SELECT patch, champion_id, role, count(DISTINCT item_id) FILTER (WHERE known) / count(DISTINCT item_id) AS share FROM bi0 GROUP BY ALL),
  bi AS (SELECT b.* FROM bi0 b JOIN cover c ON b.patch = c.patch AND b.champion_id = c.champion_id AND b.role = c.role WHERE CASE WHEN known THEN built ELSE c.share < 0.9 AND b.item_id NOT IN ({EXCLUDED}) END),
  elig AS (SELECT patch, champion_id, role, count(DISTINCT (match_id, participant_id)) AS eligible FROM bi GROUP BY ALL),
  freq AS (SELECT a.*, e.eligible, a.games / e.eligible AS frequency FROM (SELECT patch, champion_id, role, item_id, count(DISTINCT (match_id, participant_id)) AS games FROM bi GROUP BY ALL) a JOIN elig e ON a.patch = e.patch AND a.champion_id = e.champion_id AND a.role = e.role)"""


def pages_sql(policy: str = "builds") -> str:
    """The fixture's rune rows are whole pages or have lost all places; those are
    inferred, where only the shards' path (5000) and the styles (8000s, beyond
    the paths of trees) are known."""
    return """pg AS (SELECT match_id, participant_id, bool_or(tree <> 0 OR style_id <> 0) AS own, coalesce(max(style_id) FILTER (WHERE tree = 0), 0) AS s0, coalesce(max(style_id) FILTER (WHERE tree = 1), 0) AS s1,
      string_agg(cast(rune_id as string), ',' ORDER BY idx) FILTER (WHERE tree = 0) AS r0, string_agg(cast(rune_id as string), ',' ORDER BY idx) FILTER (WHERE tree = 1) AS r1, string_agg(cast(rune_id as string), ',' ORDER BY idx) FILTER (WHERE tree = 2) AS r2,
      string_agg(cast(rune_id as string), ',' ORDER BY CASE WHEN tree_kind = 2 THEN rune_id - 5001 ELSE (rune_id % 100) // 10 END, rune_id) AS r3, array_agg(rune_id ORDER BY CASE WHEN tree_kind = 2 THEN rune_id - 5001 ELSE (rune_id % 100) // 10 END, rune_id) AS l3 FROM runes GROUP BY 1, 2),
    pages AS (SELECT match_id, participant_id, CASE WHEN own THEN s0 ELSE 0 END AS primary_style, CASE WHEN own THEN s1 ELSE 0 END AS sub_style, CASE WHEN own THEN cast(s0 as string) || ':' || r0 || '|' || cast(s1 as string) || ':' || r1 || '|' || r2 ELSE '0:|0:|' || """ + ("r3" if policy == "builds" else "array_to_string(l3[1:3], ',')") + """ END AS rune_key, CASE WHEN own THEN cast(split_part(r0, ',', 1) as int) END AS keystone FROM pg)"""


def builds_sql(conf: int | str = MIN) -> str:
    return f"""{BUILT}, {pages_sql()},
  gm AS (SELECT b.patch, b.champion_id, b.role, b.match_id, b.participant_id, b.win, array_to_string(list(b.item_id ORDER BY b.item_id), ',') AS item_key, p.rune_key FROM bi b JOIN pages p ON b.match_id = p.match_id AND b.participant_id = p.participant_id GROUP BY 1, 2, 3, 4, 5, 6, 8),
  bg AS (SELECT g.*, e.eligible, g.games >= {EFF(30, "e.eligible", 2)} AS ok FROM (SELECT patch, champion_id, role, item_key, rune_key, count(*) AS games, count(*) FILTER (WHERE win) AS wins FROM gm GROUP BY ALL) g JOIN elig e ON g.patch = e.patch AND g.champion_id = e.champion_id AND g.role = e.role WHERE e.eligible >= {EFF(conf, "e.eligible", 3)}),
  bk AS (SELECT *, row_number() OVER (PARTITION BY patch, champion_id, role ORDER BY wins DESC, games DESC, item_key, rune_key) AS place FROM (SELECT *, bool_or(ok) OVER (PARTITION BY patch, champion_id, role) AS anyok FROM bg) WHERE ok OR NOT anyok),
  core AS (SELECT patch, champion_id, role, list(item_id ORDER BY item_id) AS core FROM freq WHERE frequency >= 0.7 GROUP BY ALL)"""


BUILDS = builds_sql()
BUILD_ROWS = """SELECT b.patch, b.champion_id, b.role, b.place, b.item_key, b.rune_key, b.games, b.wins, round(b.wins / b.games, 6) AS win_rate, coalesce(array_to_string(c.core, ','), '') AS core,
          coalesce((SELECT array_to_string(list(x ORDER BY x), ',') FROM (SELECT DISTINCT cast(unnest(string_split(b.item_key, ',')) as int) AS x) u WHERE c.core IS NULL OR NOT list_contains(c.core, u.x)), '') AS situational
          FROM bk b LEFT JOIN core c ON b.patch = c.patch AND b.champion_id = c.champion_id AND b.role = c.role WHERE place <= 3"""


def pro_sql(also: str = "true") -> str:
    return f"""pr AS (SELECT r.*, coalesce(o.pro_name, s.game_name || '#' || s.tag_line, s.game_name) AS player, o.team_name FROM rr r JOIN pro_roster o ON r.puuid = o.puuid AND o.is_active AND {also} LEFT JOIN summoners s ON s.puuid = o.puuid),
  il AS (SELECT match_id, participant_id, array_to_string(list(item_id ORDER BY item_id), ',') AS item_key FROM items GROUP BY 1, 2),
  prec AS (SELECT p.*, i.item_key FROM (SELECT *, row_number() OVER (PARTITION BY patch, champion_id ORDER BY match_date DESC, match_id DESC, participant_id) AS place FROM pr) p LEFT JOIN il i ON p.match_id = i.match_id AND p.participant_id = i.participant_id WHERE place <= 25)"""


PRO = pro_sql()
CHINA = "o.platform_region IN ('CN1', 'CN2')"
PRO_COLS = "patch, champion_id, place, match_id, participant_id, match_date, player, team_name, team_position, win, coalesce(item_key, '') AS item_key"


def top_players_sql(also: str = "true") -> str:
    return oracle((*RR, "pro_roster", "summoners", "items"), f"{RANKED}, {pro_sql(also)} SELECT patch, champion_id, player, team_name, games, wins, place, round(wins / games, 6) AS win_rate FROM (SELECT *, row_number() OVER (PARTITION BY patch, champion_id ORDER BY games DESC, wins / games DESC, player, team_name) AS place FROM (SELECT patch, champion_id, player, team_name, count(*) AS games, count(*) FILTER (WHERE win) AS wins FROM pr GROUP BY 1, 2, 3, 4)) WHERE place <= 10")


def common_builds_sql(also: str = "true") -> str:
    return oracle((*RR, "pro_roster", "summoners", "items"), f"{RANKED}, {pro_sql(also)} SELECT patch, champion_id, item_key, games, wins, place, round(wins / games, 6) AS win_rate FROM (SELECT *, row_number() OVER (PARTITION BY patch, champion_id ORDER BY games DESC, wins / games DESC, item_key) AS place FROM (SELECT p.patch, p.champion_id, i.item_key, count(*) AS games, count(*) FILTER (WHERE p.win) AS wins FROM pr p JOIN il i ON p.match_id = i.match_id AND p.participant_id = i.participant_id GROUP BY 1, 2, 3)) WHERE place <= 10")


POPULAR = """pop0 AS (SELECT m.patch, p.champion_id, p.team_position AS role, count(*) AS games FROM participants p JOIN matches m ON p.match_id = m.match_id WHERE m.status = 1 GROUP BY 1, 2, 3),
  pop AS (SELECT *, row_number() OVER (PARTITION BY patch, role ORDER BY games DESC, champion_id, role) AS place FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY games DESC, champion_id, role) AS n FROM pop0) WHERE n <= 100)"""


def keyed(df):
    from pyspark.sql import functions as F

    return df.withColumn("item_key", F.concat_ws(",", F.col("items").cast("array<string>"))).drop("items")


def builds(t: Tables, minimum: int | C.Sample = MIN):
    from pyspark.sql import functions as F

    got = C.champion_builds(t.matches, t.participants, t.items, t.item_versions, t.runes, t.rune_versions, None, None, minimum)
    return got.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("core", "situational")})


def runes(t: Tables, policy: str):
    return C.rune_pages(t.runes, t.rune_versions, policy).select("match_id", "participant_id", "primary_style", "sub_style", "rune_key")


QUERIES: dict[str, Query] = {
    "tier_list": (lambda t: rounded(tiers(t)), oracle(MORE, f"{RANKED}, {tier_ctes('patch, role', ALL_ROLES)} SELECT {TIER_COLS} FROM graded")),
    "tier_list_by_role": (lambda t: rounded(role_tiers(t)), oracle(MORE, f"{RANKED}, {tier_ctes('patch, role', EACH_ROLE)} SELECT {TIER_COLS} FROM graded")),
    "tier_list_emerald_plus": (
        lambda t: rounded(tiers(t, scope="Emerald+")),
        oracle(MORE, f"{RANKED}, {SOLO}, {tier_ctes('patch, role', ALL_ROLES + ' r JOIN solo s ON r.puuid = s.puuid WHERE s.tier IN ' + repr(('EMERALD', 'DIAMOND', 'MASTER', 'GRANDMASTER', 'CHALLENGER')))} SELECT {TIER_COLS} FROM graded"),
    ),
    "tier_movement": (
        lambda t: rounded(C.tier_movement(tiers(t), t.patches)),
        oracle((*MORE, "patches"), f"""{RANKED}, {tier_ctes('patch, role', ALL_ROLES)}, prev AS (SELECT patch, lead(patch) OVER (ORDER BY released_at DESC, patch DESC) AS previous FROM (SELECT * FROM patches ORDER BY released_at DESC, patch DESC LIMIT 10)),
          mv AS (SELECT g.*, h.grade AS previous_grade, strpos('DCBAS', g.grade) - strpos('DCBAS', h.grade) AS step FROM graded g LEFT JOIN prev p ON g.patch = p.patch LEFT JOIN graded h ON h.patch = p.previous AND h.champion_id = g.champion_id AND h.role = g.role)
          SELECT {TIER_COLS}, previous_grade, CASE WHEN previous_grade IS NULL THEN 'NEW' WHEN step > 0 THEN 'UP' WHEN step < 0 THEN 'DOWN' ELSE 'SAME' END AS movement FROM mv"""),
    ),
    "champion_winrates": (lambda t: rounded(winrates(t)), oracle(MORE, f"{RANKED}, {SOLO}, {WINRATES} SELECT {WR_COLS} FROM wr")),
    "champion_winrates_kr": (lambda t: rounded(winrates(t, region="KR")), oracle((*MORE, "summoners"), f"{ranked_in(KOREA)}, {SOLO}, {WINRATES} SELECT {WR_COLS} FROM wr")),
    "champion_winrates_asia": (lambda t: rounded(winrates(t, region="asia")), oracle((*MORE, "summoners"), f"{ranked_in(ASIA)}, {SOLO}, {WINRATES} SELECT {WR_COLS} FROM wr")),
    "champion_winrates_early_patch": (lambda t: rounded(winrates(t, early(t))), oracle((*MORE, "patches"), f"{RANKED}, {SOLO}, {winrates_sql(EARLY.format('wr1'))} SELECT {WR_COLS} FROM wr")),
    "role_ranks_kr": (lambda t: C.role_ranks(t.matches, t.participants, t.ranks, t.summoners, "KR"), oracle((*MORE, "summoners"), f"{ranked_in(KOREA)}, {SOLO}, {WINRATES} SELECT patch, role, rank_tier, champion_id, games, wins, role_rank, role_population FROM rrank")),
    "tier_list_early_patch": (lambda t: rounded(tiers(t, minimum=early(t))), oracle((*MORE, "patches"), f"{RANKED}, {tier_ctes('patch, role', ALL_ROLES, EARLY.format('a'))} SELECT {TIER_COLS} FROM graded")),
    "role_ranks": (lambda t: C.role_ranks(t.matches, t.participants, t.ranks), oracle(MORE, f"{RANKED}, {SOLO}, {WINRATES} SELECT patch, role, rank_tier, champion_id, games, wins, role_rank, role_population FROM rrank")),
    "item_frequency": (lambda t: rounded(frequency(t)), oracle((*RR, "items", "item_versions"), f"{RANKED}, {BUILT} SELECT patch, champion_id, role, item_id, games, eligible, round(frequency, 6) AS frequency, frequency >= 0.7 AS is_core FROM freq")),
    "champion_builds": (
        lambda t: rounded(builds(t)),
        oracle((*RR, "items", "item_versions", "runes"), f"{RANKED}, {BUILDS} {BUILD_ROWS}"),
    ),
    "champion_builds_early_patch": (lambda t: rounded(builds(t, early(t))), oracle((*RR, "items", "item_versions", "runes", "patches"), f"{RANKED}, {builds_sql(EARLY.format('g'))} {BUILD_ROWS}")),
    "rune_pages": (lambda t: runes(t, "builds"), oracle(("runes",), f"{pages_sql()} SELECT match_id, participant_id, primary_style, sub_style, rune_key FROM pages")),
    "rune_pages_history": (lambda t: runes(t, "history"), oracle(("runes",), f"{pages_sql('history')} SELECT match_id, participant_id, primary_style, sub_style, rune_key FROM pages")),
    "rune_pages_detail": (lambda t: runes(t, "detail"), oracle(("runes",), f"{pages_sql('detail')} SELECT match_id, participant_id, primary_style, sub_style, rune_key FROM pages")),
    "lane_matchups": (lambda t: rounded(matchups(t)), oracle((*RR, "frames"), f"{RANKED}, {MATCHUPS} SELECT {MU_COLS} FROM mu")),
    "matchup_verdicts": (lambda t: rounded(C.matchup_verdicts(matchups(t))), oracle((*RR, "frames"), f"{RANKED}, {MATCHUPS} SELECT patch, champion_id, role, opponent_id, games, round(win_rate, 6) AS win_rate, CASE WHEN win_rate >= 0.52 THEN 'favorable' WHEN win_rate <= 0.48 THEN 'unfavorable' ELSE 'even' END AS verdict FROM mu")),
    "counters_and_favorable": (
        lambda t: rounded(C.counters_and_favorable(matchups(t))),
        oracle((*RR, "frames"), f"""{RANKED}, {MATCHUPS} SELECT patch, champion_id, role, side, place, opponent_id, games, round(win_rate, 6) AS win_rate FROM (
          SELECT *, 'counter' AS side, row_number() OVER (PARTITION BY patch, champion_id, role ORDER BY win_rate, games DESC, opponent_id) AS place FROM mu WHERE win_rate < 0.48
          UNION ALL SELECT *, 'favorable', row_number() OVER (PARTITION BY patch, champion_id, role ORDER BY win_rate DESC, games DESC, opponent_id) FROM mu WHERE win_rate > 0.52) WHERE place <= 5"""),
    ),
    "timeline_quality": (lambda t: rounded(C.timeline_quality(matchups(t))), oracle((*RR, "frames"), f"{RANKED}, {MATCHUPS} SELECT patch, champion_id, role, cast(sum(games) as bigint) AS games, cast(sum(timeline_games) as bigint) AS sample_size, max(derived_at) AS derived_at, round(sum(timeline_games) / sum(games), 6) AS coverage FROM mu GROUP BY 1, 2, 3")),
    "popular_champions": (lambda t: C.popular_champions(t.matches, t.participants), oracle(RR, f"{POPULAR} SELECT patch, champion_id, role, games, place FROM pop WHERE place <= 12")),
    "analytics_grid": (
        lambda t: rounded(C.analytics_grid(t.matches, t.participants, t.bans, t.ranks, MIN)),
        oracle(MORE, f"""{RANKED}, {SOLO}, ex AS (SELECT r.*, s.tier FROM rr r LEFT JOIN solo s ON r.puuid = s.puuid),
          sc AS (SELECT *, 'ALL' AS rank_scope FROM ex UNION ALL SELECT *, tier FROM ex WHERE tier IS NOT NULL UNION ALL SELECT *, 'EMERALD_PLUS' FROM ex WHERE tier IN ('EMERALD', 'DIAMOND', 'MASTER', 'GRANDMASTER', 'CHALLENGER')),
          {tier_ctes('patch, role, rank_scope', "SELECT patch, team_position AS role, rank_scope, match_id, champion_id, win FROM sc UNION ALL SELECT patch, 'ALL', rank_scope, match_id, champion_id, win FROM sc")} SELECT rank_scope, {TIER_COLS} FROM graded"""),
    ),
    "analytics_grid_winrates": (lambda t: rounded(C.of_popular(winrates(t), C.popular_champions(t.matches, t.participants))), oracle(MORE, f"{RANKED}, {SOLO}, {WINRATES}, {POPULAR} SELECT {WR_COLS} FROM wr WHERE (patch, champion_id, role) IN (SELECT (patch, champion_id, role) FROM pop WHERE place <= 12)")),
    "analytics_grid_builds": (lambda t: rounded(C.of_popular(builds(t), C.popular_champions(t.matches, t.participants))), oracle((*RR, "items", "item_versions", "runes"), f"{RANKED}, {BUILDS}, {POPULAR} {BUILD_ROWS} AND (b.patch, b.champion_id, b.role) IN (SELECT (patch, champion_id, role) FROM pop WHERE place <= 12)")),
    "analytics_grid_matchups": (lambda t: rounded(C.of_popular(matchups(t), C.popular_champions(t.matches, t.participants))), oracle((*RR, "frames"), f"{RANKED}, {MATCHUPS}, {POPULAR} SELECT {MU_COLS} FROM mu WHERE (patch, champion_id, role) IN (SELECT (patch, champion_id, role) FROM pop WHERE place <= 12)")),
    "current_patch": (lambda t: C.current_patch(t.patches, t.matches), oracle(("patches",), "one AS (SELECT 1) SELECT max(patch) AS patch FROM patches WHERE is_active")),
    "pro_recent_matches": (lambda t: keyed(C.pro_recent_matches(*pro(t), t.items)), oracle((*RR, "pro_roster", "summoners", "items"), f"{RANKED}, {PRO} SELECT {PRO_COLS} FROM prec")),
    "pro_recent_matches_cn_middle": (lambda t: keyed(C.pro_recent_matches(*pro(t), t.items, region="cn", role="middle")), oracle((*RR, "pro_roster", "summoners", "items"), f"{RANKED}, {pro_sql(CHINA + ' AND r.team_position = ' + repr('MIDDLE'))} SELECT {PRO_COLS} FROM prec")),
    "pro_top_players_cn": (lambda t: rounded(C.pro_top_players(*pro(t), region="CN")), top_players_sql(CHINA)),
    "pro_common_builds_kr": (lambda t: rounded(C.pro_common_builds(*pro(t), t.items, region="KR")), common_builds_sql("o.platform_region = 'KR'")),
    "pro_top_players": (lambda t: rounded(C.pro_top_players(*pro(t))), top_players_sql()),
    "pro_common_builds": (lambda t: rounded(C.pro_common_builds(*pro(t), t.items)), common_builds_sql()),
    "pro_feed": (
        lambda t: C.pro_feed(C.pro_recent_matches(*pro(t), t.items), C.popular_champions(t.matches, t.participants)),
        oracle((*RR, "pro_roster", "summoners", "items"), f"""{RANKED}, {PRO}, {POPULAR}, most AS (SELECT patch, champion_id FROM (SELECT patch, champion_id, row_number() OVER (PARTITION BY patch ORDER BY sum(games) DESC, champion_id) AS n FROM pop WHERE place <= 12 GROUP BY 1, 2) WHERE n <= 8),
          fd AS (SELECT p.*, row_number() OVER (PARTITION BY p.patch, p.match_id, p.champion_id ORDER BY participant_id) AS k FROM prec p JOIN most m ON p.patch = m.patch AND p.champion_id = m.champion_id WHERE p.place <= 8)
          SELECT patch, feed_place, champion_id, match_id, player, win FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY match_date DESC, match_id DESC, champion_id) AS feed_place FROM fd WHERE k = 1) WHERE feed_place <= 48"""),
    ),
    "tier_board": (
        lambda t: rounded(C.tier_board(tiers(t))),
        oracle(MORE, f"{RANKED}, {tier_ctes('patch, role', ALL_ROLES)} SELECT *, CASE WHEN win_rate >= 0.53 THEN 'S' WHEN win_rate >= 0.51 THEN 'A' WHEN win_rate >= 0.49 THEN 'B' WHEN win_rate >= 0.47 THEN 'C' ELSE 'D' END AS rate_grade, global_rank <= 8 AS is_top, trend_rank <= 3 AS is_trending FROM (SELECT patch, role, champion_id, grade, games, round(win_rate, 6) AS win_rate, row_number() OVER (PARTITION BY patch, role ORDER BY strpos('SABCD', grade), score DESC, champion_id) AS global_rank, row_number() OVER (PARTITION BY patch, role ORDER BY wins / games DESC, games DESC, champion_id) AS trend_rank FROM graded)"),
    ),
    "main_role": (
        lambda t: C.main_role(winrates(t)),
        oracle(MORE, f"{RANKED}, {SOLO}, {WINRATES} SELECT patch, champion_id, role, role_games, tier_of_most, tier_games FROM (SELECT *, row_number() OVER (PARTITION BY patch, champion_id ORDER BY role_games DESC, role) AS n FROM (SELECT patch, champion_id, role, cast(sum(games) as bigint) AS role_games, arg_max(rank_tier, (games, rank_tier)) AS tier_of_most, max(games) AS tier_games FROM wr GROUP BY 1, 2, 3)) WHERE n = 1"),
    ),
    "matchup_index": (
        lambda t: C.matchup_index(role_tiers(t)),
        oracle(MORE, f"""{RANKED}, {tier_ctes('patch, role', EACH_ROLE)}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY games DESC, champion_id, role) AS nn FROM graded) WHERE nn <= 120)
          SELECT a.patch, a.role, a.place2 AS place, a.champion_id, a.games, r.roles FROM (SELECT *, row_number() OVER (PARTITION BY patch, role ORDER BY games DESC, champion_id, role) AS place2 FROM top) a JOIN (SELECT patch, champion_id, string_agg(role, ',' ORDER BY role) AS roles FROM top GROUP BY 1, 2) r ON a.patch = r.patch AND a.champion_id = r.champion_id WHERE place2 <= 48"""),
    ),
    "unit_win_percents": (
        lambda t: rounded(C.unit_win_percents(t.matches, t.participants, t.items, t.runes, t.ranks)),
        oracle((*MORE, "items", "runes"), f"""{RANKED}, {SOLO} SELECT r.patch, r.champion_id, r.team_position AS lane, coalesce(s.tier, 'UNRANKED') AS rank_tier, u.kind, u.unit, count(*) AS games, round(count(*) FILTER (WHERE r.win) / count(*), 6) AS win_rate
          FROM rr r LEFT JOIN solo s ON r.puuid = s.puuid JOIN (SELECT match_id, participant_id, 'item' AS kind, item_id AS unit FROM items UNION SELECT match_id, participant_id, 'rune', rune_id FROM runes) u ON r.match_id = u.match_id AND r.participant_id = u.participant_id GROUP BY 1, 2, 3, 4, 5, 6"""),
    ),
}
QUERIES["incremental_grid"] = (lambda t: rounded(incremental_grid(t)), QUERIES["analytics_grid"][1])
