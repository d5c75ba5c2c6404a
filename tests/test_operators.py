"""Hand-written cases: thresholds, ties, quirks and empty scopes."""

import random

from pyspark.sql import functions as F

from riftstats.functions import exprs as X
from riftstats.operators import champions as C
from riftstats.operators import ingest as I
from riftstats.operators import live as L
from riftstats.operators import players as P
from riftstats.operators import worklists as K


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_wilson(spark):
    got = [value(spark, X.wilson(F.lit(w), F.lit(g))) for w, g in ((0, 0), (0, 10), (5, 10), (10, 10))]
    assert [round(x, 4) for x in got] == [0.0, 0.0, 0.2366, 0.7225]


def test_effective_minimum(spark):
    cases = {(100, 0, 5): 1, (100, 1, 5): 1, (100, 10, 5): 5, (100, 1000, 5): 100, (100, 400, 3): 60, (30, 10, 2): 2}
    for (conf, avail, floor), want in cases.items():
        assert value(spark, X.effective_minimum(conf, F.lit(avail), floor)) == want


def test_adaptive_minimum(spark):
    hour = 3_600_000
    assert value(spark, X.adaptive_minimum(F.lit(0), 71 * hour)) == 40
    assert value(spark, X.adaptive_minimum(F.lit(0), 72 * hour)) == 100
    assert value(spark, X.adaptive_minimum(F.lit(None).cast("long"), 0)) == 100


def test_tier_scopes():
    assert X.tier_scope("Emerald+") == X.tier_scope("emerald_plus") == X.EMERALD_PLUS
    assert X.tier_scope("diamond") == ["DIAMOND"]
    assert X.tier_scope("all") is X.tier_scope(None) is X.tier_scope(" ") is None


def test_queue_labels(spark):
    ids = [420, 440, 450, 900, 12345, 0, 830, 1710, 700]
    rows = spark.createDataFrame([(i,) for i in ids], "q int").select(X.queue_label(F.col("q")).alias("l"), X.queue_family(F.col("q")).alias("f")).collect()
    assert [r.l for r in rows][:5] == ["Ranked Solo/Duo", "Ranked Flex", "ARAM", "900", "12345"]
    assert [r.f for r in rows] == ["RANKED_SOLO_DUO", "RANKED_FLEX", "ARAM", "ROTATING", "OTHER", "CUSTOM", "BOT", "ARENA", "CLASH"]


def test_age_bucket_and_roles(spark):
    minute = 60_000
    got = [value(spark, X.age_bucket(F.lit(0), n * minute)) for n in (0, 5, 150, 3000)]
    assert got == ["Just now", "5 minutes ago", "2 hours ago", "2 days ago"]
    assert [value(spark, X.role_alias(F.lit(r))) for r in ("support", "NONE", "", "top")] == ["UTILITY", "UNKNOWN", "UNKNOWN", "TOP"]


def tiers(spark, rows):
    return spark.createDataFrame(rows, "patch string, role string, champion_id int, grade string, games long, win_rate double, score double")


def test_movement_default_and_compat(spark):
    t = tiers(spark, [("2", "ALL", 1, "S", 9, 0.5, 0.9), ("2", "ALL", 2, "B", 9, 0.5, 0.5), ("2", "ALL", 3, "S", 9, 0.5, 0.8), ("1", "ALL", 2, "A", 9, 0.5, 0.5), ("1", "ALL", 3, "B", 9, 0.5, 0.5)])
    patches = spark.createDataFrame([("1", 1), ("2", 2)], "patch string, released_at long")
    now = {r.champion_id: r.movement for r in C.tier_movement(t, patches).where("patch = '2'").collect()}
    assert now == {1: "NEW", 2: "DOWN", 3: "UP"}
    old = {r.champion_id: (r.previous_grade, r.movement) for r in C.tier_movement(t, patches, compat=True).where("patch = '2'").collect()}
    assert old[1] == ("S", "SAME")


def test_keep_all_where_no_group_is_large(spark):
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9), ("b", 1)], "s string, games int")
    assert sorted(tuple(r) for r in C.keep_enough(g, F.lit(5), "s").collect()) == [("a", 1), ("a", 2), ("b", 9)]


def test_tier_board_cleans(spark):
    t = tiers(spark, [("1", "ALL", 1, "A", 5, 0.5, 0.4), ("1", "ALL", 2, "S", 5, 0.6, float("nan")), ("1", "ALL", 3, "Z", 5, 0.6, 0.1), ("1", "ALL", 0, "S", 5, 0.6, 0.1)])
    assert {r.champion_id: r.global_rank for r in C.tier_board(t).collect()} == {2: 1, 1: 2}


def rune_rows(spark, rows):
    return spark.createDataFrame([("m", 1, *r) for r in rows], "match_id string, participant_id int, patch string, rune_id int, tree int, idx int, style_id int")


VERSIONS = [(1, "p", 100, 0), (2, "p", 100, 1), (3, "p", 200, 0), (4, "p", 5000, 0), (5, "q", 300, 0)]


def test_rune_pages_policies(spark):
    versions = spark.createDataFrame(VERSIONS, "rune_id int, patch string, path_id int, slot int")
    whole = rune_rows(spark, [("p", 2, 0, 1, 0), ("p", 1, 0, 0, 0), ("p", 3, 1, 0, 0), ("p", 4, 2, 0, 0)])
    assert C.rune_pages(whole, versions).first().rune_key == "100:1,2|200:3|4"
    lost = rune_rows(spark, [("p", x, 0, 0, 0) for x in (2, 1, 3, 4, 5, 9)])
    assert C.rune_pages(lost, versions).first().rune_key == "100:1,2|200:3|4"
    assert C.rune_pages(lost, versions, "history").first().rune_key == "100:1,2|200:3|4"
    twice = rune_rows(spark, [("p", 1, 1, 0, 0), ("p", 2, 1, 0, 0)])  # a place twice isn't a page of its own
    assert C.rune_pages(twice, versions).first().primary_style == 100


def test_backfill_puts_unknown_runes_in_primary_up_to_four(spark):
    versions = spark.createDataFrame(VERSIONS, "rune_id int, patch string, path_id int, slot int")
    lost = rune_rows(spark, [("p", x, 0, 0, 0) for x in (1, 2, 3, 4, 70, 71, 72)])
    got = {r.rune_id: (r.tree, r.style_id) for r in I.backfill_rune_selections(lost, versions).collect()}
    assert got == {1: (0, 100), 2: (0, 100), 3: (1, 200), 4: (2, 0), 70: (0, 100), 71: (0, 100), 72: (1, 200)}


def test_snapshots(spark):
    m = spark.createDataFrame([("a", 1800), ("b", 600), ("c", 1800)], "match_id string, duration int")
    p = spark.createDataFrame([(x, "x", 1) for x in "abc"], "match_id string, puuid string, participant_id int")
    f = spark.createDataFrame([("a", None, "x", 840_000, 1), ("a", None, "x", 900_000, 2), ("a", None, "x", 960_000, 3), ("b", 1, "x", 480_000, 4), ("c", 1, "x", 960_000, 5), ("c", 1, "x", 1_000_000, 6)], "match_id string, participant_id int, puuid string, timestamp_ms int, total_gold int").withColumns({c: F.lit(0) for c in ("xp", "cs", "level")})
    got = {r.match_id: (r.gold, r.quality_flags) for r in I.timeline_snapshots(m, p, f).collect()}
    assert got == {"a": (2, "EXACT"), "b": (4, "PRIOR_FRAME|SHORT_GAME"), "c": (5, "AFTER_TARGET")}


def test_fetch_attempts(spark):
    day = 86_400_000
    rows = [(f"f{n}", 0, i, False) for n in range(1, 7) for i in range(n)] + [("ok", 0, 0, False), ("ok", 0, 1, True), ("old", -731 * day, 0, True)]
    got = {r.match_id: (r.status, None if r.next_attempt_at is None else (r.next_attempt_at - r.last_attempt_at) // 1000) for r in I.fold_fetch_attempts(spark.createDataFrame(rows, "match_id string, match_date long, at long, ok boolean"), 0).collect()}
    assert got == {"f1": (2, 30), "f2": (2, 60), "f3": (2, 120), "f4": (2, 300), "f5": (3, None), "f6": (3, None), "ok": (1, None), "old": (4, None)}


def test_rank_history_keeps_no_repeats(spark):
    schema = "puuid string, queue_type string, tier string, division string, league_points int, wins int, losses int"
    now = spark.createDataFrame([("a", "q", "GOLD", "I", 1, 1, 1), ("b", "q", "GOLD", "I", 1, 1, 1)], schema)
    new = spark.createDataFrame([("a", "q", "GOLD", "I", 2, 2, 1), ("b", "q", "GOLD", "I", 2, 2, 1)], schema)
    had = now.where("puuid = 'b'")
    assert [r.puuid for r in I.rank_history(now, new, had).collect()] == ["a"]
    assert {r.puuid: r.change for r in I.upsert_ranks(now, new.union(now.where("false"))).collect()} == {"a": "updated", "b": "updated"}


def test_cursor_is_frozen_by_failures(spark):
    c = spark.createDataFrame([(x, "s", 100, 1, 1) for x in "abc"], "puuid string, scope string, before_epoch_s long, noop_runs int, version int")
    r = spark.createDataFrame([("a", "s", 50, 3, False, False), ("b", "s", 50, 0, False, True), ("c", "s", 500, 0, False, False)], "puuid string, scope string, oldest_match_s long, persisted long, stopped_early boolean, failed boolean")
    got = {x.puuid: (x.before_epoch_s, x.noop_runs, x.version) for x in I.advance_cursors(c, r).collect()}
    assert got == {"a": (49, 0, 2), "b": (100, 2, 2), "c": (100, 2, 2)}


def test_live_teams(spark):
    rows = spark.createDataFrame([(1, 100, "DIAMOND", 0.6, 0.55), (1, 200, None, None, None)], "game_id int, team_id int, tier string, recent_win_rate double, champion_win_rate double")
    got = {r.team_id: r for r in L.live_team_analysis(rows).collect()}
    assert got[100].strengths == "recent_form,champion_pool,rank" and got[200].weaknesses == "rank"
    assert round(got[100].win_probability + got[200].win_probability, 9) == 1
    assert abs(got[200].score - (0.2 + 0.2 + 0.06)) < 1e-12


def test_lookup_priorities_and_platforms(spark):
    s = spark.createDataFrame([("p1", "Ann", "EU", "EUW1", 1), ("p2", " Bob", "X", "NA1", 2)], "puuid string, game_name string, tag_line string, platform_region string, updated_at long")
    w = spark.createDataFrame([(1, " ann", "eu", "euw"), (2, " Bob", "X", "N-A"), (3, " bob", "x", "NA1"), (4, "zed", "x", "NA1")], "request int, game_name string, tag_line string, platform string")
    assert sorted((r.request, r.puuid, r.priority) for r in P.find_by_name(w, s).collect()) == [(1, "p1", 1), (2, "p2", 2), (3, "p2", 3)]


def test_empty_favorites_poll_everybody(spark):
    s = spark.createDataFrame([("p1", "Ann", "EU", "EUW1", 1)], "puuid string, game_name string, tag_line string, platform_region string, updated_at long")
    none = spark.createDataFrame([], "user_id long, puuid string, platform_region string")
    prefs = spark.createDataFrame([], "user_id long, live_polling_enabled boolean")
    assert K.pollable_players(s, none, prefs).count() == 1


def test_matchups_mirror(spark):
    from riftstats.plans.analytics import snapshots
    from riftstats.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    m = C.lane_matchups(t.matches, t.participants, snapshots(t), minimum=1)
    a = m.select("patch", "role", "champion_id", "opponent_id", "wins")
    b = m.select("patch", "role", F.col("opponent_id").alias("champion_id"), F.col("champion_id").alias("opponent_id"), "losses")
    j = a.join(b, ["patch", "role", "champion_id", "opponent_id"])
    assert j.where("wins <> losses").count() == 0 and j.count() > 0


def test_scores_are_rounded_before_they_rank(spark):
    """Three lost games of 64: the score is 0.0140625, whatever the order of the
    operations; equal scores tie and go by champion."""
    rows = spark.createDataFrame([("8.1", f"m{i}", c, w, [("JUNGLE",)]) for i, (c, w) in enumerate([(40, False)] * 3 + [(39, False)] * 3 + [(7, i % 2 == 0) for i in range(58)])], "patch string, match_id string, champion_id int, win boolean, scopes array<struct<role:string>>")
    got = {r.champion_id: r for r in C.tier_scores(rows, spark.createDataFrame([("m0", 40)], "match_id string, champion_id int"), 1).collect()}
    assert got[40].score == got[39].score == 0.0140625 and got[39].place == got[40].place - 1
    assert got[40].ban_rate == 1 / 64 and got[7].ban_rate == 0


def test_minimum_of_a_new_patch(spark):
    groups = spark.createDataFrame([("9.1",), ("9.2",), ("none",)], "patch string")
    patches = spark.createDataFrame([("9.1", 0), ("9.2", 10 * 3_600_000)], "patch string, released_at long")
    at = lambda now, **more: {r.patch: r._minimum for r in C.Sample(patches=patches, now_ms=now * 3_600_000, **more).on(groups).collect()}
    assert at(71) == {"9.1": 40, "9.2": 40, "none": 100} and at(72) == {"9.1": 100, "9.2": 40, "none": 100}
    assert at(1, early=500) == {"9.1": 100, "9.2": 100, "none": 100} and at(1, hours=0) == {"9.1": 100, "9.2": 100, "none": 100}
    assert {r._minimum for r in C.Sample(60).on(groups).collect()} == {60}


def test_a_rune_of_any_patch_is_that_of_the_latest(spark):
    runes = spark.createDataFrame([("m", 1, 0, 0, 7, 0, "15.1")], "match_id string, participant_id int, tree int, idx int, rune_id int, style_id int, patch string")
    versions = spark.createDataFrame([(7, "9.2", 100, 1), (7, "14.1", 200, 2)], "rune_id int, patch string, path_id int, slot int")
    assert C.rune_pages(runes, versions, "history").first().primary_style == 200


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans_shuffle_no_more_than_they_need(spark):
    """Shuffles of the plans over landed tables, as planned before any is found
    small enough to be sent out; what is reused counts each time."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        none = lambda ddl: spark.createDataFrame([], ddl)
        m = none("match_id string, match_date long, duration int, patch string, queue_id int, queue_type string, status int")
        p = none("match_id string, participant_id int, team_id int, puuid string, champion_id int, team_position string, win boolean")
        items, bans = none("match_id string, participant_id int, slot int, item_id int"), none("match_id string, champion_id int")
        runes = none("match_id string, participant_id int, tree int, idx int, rune_id int, style_id int, patch string")
        ranks = none("puuid string, queue_type string, tier string")
        snaps = none("match_id string, participant_id int, gold int, xp int, derived_at long")
        # players and matches by match, bans or snapshots by match, the counts, the scopes
        assert exchanges(C.tier_list(m, p, bans)) <= 5
        assert exchanges(C.lane_matchups(m, p, snaps)) <= 5
        # players and matches, players by tier (2), three tables by participant, the counts
        assert exchanges(C.unit_win_percents(m, p, items, runes, ranks)) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def empty_tables(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    m = none("match_id string, match_key long, match_date long, duration int, patch string, queue_id int, queue_type string, status int, fetched_at long")
    p = none("match_id string, participant_id int, team_id int, puuid string, champion_id int, team_position string, win boolean, kills int, deaths int, assists int, vision_score int, damage int, minions int, neutral int, gold_earned int")
    return m, p, none("match_id string, champion_id int"), none("puuid string, queue_type string, tier string"), none("match_id string, participant_id int, slot int, item_id int"), none("match_id string, participant_id int, patch string, tree int, idx int, rune_id int, style_id int, tree_kind int")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_of_histories_is_limited_early(spark, monkeypatch):
    """Places are limited before the shuffle, and items and runes are reduced to the
    page's rows before they are gathered."""
    monkeypatch.setattr(P, "shared", lambda df: df)
    m, p, _, _, items, runes = empty_tables(spark)
    versions = spark.createDataFrame([], "rune_id int, patch string, path_id int, slot int")
    text = plan_of(P.match_history(m, p, items, runes, versions))
    assert "WindowGroupLimit" in text
    for part in text.split("partial_collect_list")[1:]:
        assert "LeftSemi" in part


def test_carried_items_and_runes_give_the_histories_of_tables(spark):
    """Also with places lost, repeated or null, unknown runes and patches, empty slots,
    more items than slots, and players without any."""
    rng = random.Random(4)
    m, p, _, _, items, runes = empty_tables(spark)
    matches = [(f"m{i}", i, i % 7, 900, rng.choice(["14.1", "14.2", "15.9"]), rng.choice([420, 440, 0]), rng.choice(["420", "x"]), rng.choice([1, 3]), i) for i in range(40)]
    people = [(f"m{i}", k, 100, f"p{rng.randrange(6)}", k, "TOP", bool(k % 2), *[1] * 8) for i in range(40) for k in range(1, 6)]
    held = [(f"m{i}", k, slot, rng.choice([0, 7, 8, 9])) for i in range(40) for k in range(1, 6) if (i + k) % 4 for slot in range(rng.randrange(10))]
    worn = []
    for i in range(40):
        for k in range(1, 6):
            lost, none = rng.random() < 0.3, rng.random() < 0.2
            for tree, idx in [] if none else [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]:
                place = (0, 0, 0) if lost else (rng.choice([tree] * 30 + [None]), rng.choice([idx] * 30 + [0, None]), rng.choice([8000, 8000, 8100, 0, 0, None]))
                worn.append((f"m{i}", k, matches[i][4], place[0], place[1], rng.choice([8001, 8002, 8101, 8102, 8201, 5001, 5002, 77, None]), place[2], tree))
    m, p = spark.createDataFrame(matches, m.schema), spark.createDataFrame(people, p.schema)
    items, runes = spark.createDataFrame(held, items.schema), spark.createDataFrame(worn, runes.schema)
    versions = [(r, v, r // 100 * 100 if r > 7000 else 5000, r % 10) for r in (8001, 8002, 8101, 8102, 5001, 5002) for v in ("14.1", "14.2") if (r, v) != (8002, "14.2")]
    versions = spark.createDataFrame([*versions, (8201, "14.1", None, None)], "rune_id int, patch string, path_id int, slot int")
    key = ["match_id", "participant_id"]
    of_items = items.groupBy(*key).agg(F.collect_list(F.struct("slot", "item_id")).alias("items"))
    of_runes = runes.groupBy(*key).agg(F.collect_list(F.struct("tree", "idx", "rune_id", "style_id")).alias("runes"))
    carried = lambda rows: rows.join(of_items, key, "left").join(of_runes, key, "left")
    for more in ({}, {"page": 2, "size": 3, "queue_ids": [420]}, {"family": "ranked_flex"}):
        want = P.match_history(m, p, items, runes, versions, **more).collect()
        got = P.match_history(m, p, None, None, versions, carried=carried, **more).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
        counts = {}
        for x in p.join(P.visible_matches(m), "match_id").where("queue_id = 440" if "family" in more else "queue_id = 420 or queue_type = '420'" if more else "true").collect():
            counts[x.puuid] = counts.get(x.puuid, 0) + 1
        assert all(x.total == counts[x.puuid] for x in got)


def test_win_rates_read_participants_once_without_expanding(spark):
    m, p, bans, ranks, _, _ = empty_tables(spark)
    text = plan_of(C.champion_winrates(m, p, bans, ranks))
    assert "Expand" not in text and text.count("vision_score") == plan_of(p).count("vision_score")


def test_grid_counts_of_batches_add_up(spark, tmp_path):
    """Counts of batches in any split, one applied twice, are those of all; a batch
    reads and switches the partitions of its own patches only."""
    from riftstats.sources.versioned import VersionedTable

    rng = random.Random(9)
    matches = [(f"m{i}", i, i, 900, f"14.{i % 3}", 420, "", 1, i) for i in range(60)]
    people = [(f"m{i}", k, 100 + 100 * (k % 2), f"p{rng.randrange(9)}", rng.randrange(5), rng.choice(["TOP", "JUNGLE"]), bool(k % 2), 1, 1, 1, 1, 1, 1, 1, 1) for i in range(60) for k in range(4)]
    m0, p0, b0, r0, *_ = empty_tables(spark)
    m, p = spark.createDataFrame(matches, m0.schema), spark.createDataFrame(people, p0.schema)
    b = spark.createDataFrame([(f"m{i}", rng.randrange(5)) for i in range(60) for _ in range(2)], b0.schema)
    r = spark.createDataFrame([(f"p{i}", "RANKED_SOLO_5x5", "GOLD" if i % 2 else "MASTER") for i in range(7)], r0.schema)
    mart = VersionedTable(spark, f"file://{tmp_path}/mart", F.col("patch"))
    for n, (lo, hi) in enumerate([(0, 10), (10, 41), (41, 60)]):
        for _ in range(2):
            C.refresh_grid(mart, m.where(f"match_key >= {lo} and match_key < {hi}"), p, b, r, n)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(mart.read().select("patch", "role", "rank_scope", "champion_id", "games", "wins", "banned")) == rows(C.grid_counts(m, p, b, r).select("patch", "role", "rank_scope", "champion_id", "games", "wins", "banned"))
    assert rows(C.scores_of(mart.read(), 3)) == rows(C.analytics_grid(m, p, b, r, 3))
    before = mart.pointer()["parts"]
    C.refresh_grid(mart, spark.createDataFrame([("new", 99, 1, 900, "14.1", 420, "", 1, 1)], m0.schema), p.where("match_id = 'm1'").withColumn("match_id", F.lit("new")), b, r, 3)
    after = mart.pointer()["parts"]
    assert [n for n in after if after[n] != before[n]] == ["k14.1"]
