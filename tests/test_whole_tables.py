"""Queries that model two states or look-ups take every row of their tables."""

import pytest

from riftstats.operators import champions as C
from riftstats.plans import landing, people, registry
from riftstats.sources.fixtures import Tables


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_sides_are_whole(tables):
    n = {x: getattr(tables, x).count() for x in ("matches", "ranks", "summoners")}
    assert landing.versions(tables).count() == n["matches"]
    assert [x.count() for x in landing.match_sides(tables)] == [n["matches"]] * 2
    assert landing.current_ranks(tables).count() == landing.incoming_ranks(tables).count() == n["ranks"]
    assert people.wanted(tables.summoners).count() == n["summoners"]


def test_every_row_comes_out(tables):
    run = lambda name: registry.ALL[name][0](tables)
    assert run("find_all_by_name").select("request").distinct().count() == tables.summoners.count()
    assert {r.change for r in run("upsert_all_ranks").select("change").distinct().collect()} == {"inserted", "kept", "same", "updated"}
    bare = lambda df: df.selectExpr("regexp_replace(puuid, '^[CN]_', '') p").distinct()
    for name, table in (("upsert_all_ranks", tables.ranks), ("upsert_all_summoners", tables.summoners)):
        assert bare(table).exceptAll(bare(run(name))).count() == 0, name
    assert run("refresh_all_decisions").count() > 5


def test_regions(tables):
    t = tables
    own = t.summoners.where("platform_region = 'NA1'").select("puuid")
    rows = t.participants.join(own, "puuid", "left_semi")
    plain = lambda df: sorted(map(str, df.collect()))
    for f, more in ((C.role_ranks, (t.ranks,)), (C.champion_winrates, (t.bans, t.ranks, 5))):
        got = plain(f(t.matches, t.participants, *more, summoners=t.summoners, region=" na1"))
        assert got and got == plain(f(t.matches, rows, *more))
        assert plain(f(t.matches, t.participants, *more, summoners=t.summoners, region="AMERICAS")) != got
    pro = lambda **k: C.pro_recent_matches(t.matches, t.participants, t.pro_roster, t.summoners, t.items, **k)
    china = t.pro_roster.where("platform_region in ('CN1', 'CN2')")
    got = plain(pro(region="cn"))
    assert got and got == plain(C.pro_recent_matches(t.matches, t.participants, china, t.summoners, t.items))
    assert {r.team_position for r in pro(role="jungle").collect()} == {"JUNGLE"}


def test_live_games_hold_all_their_players(tables):
    """Each player of a game gets every player of it, whatever their number."""
    from riftstats.operators import live as L

    last = L.live_state_latest(tables.live_snapshots, people.NOW).where("state = 'in_game'")
    known = last.join(tables.summoners.select("puuid"), "puuid", "left_semi").selectExpr("puuid", "game_id % 40 game_id")
    want = known.join(last.selectExpr("game_id % 40 game_id", "puuid participant_puuid"), "game_id").select("puuid", "game_id", "participant_puuid")
    got = registry.ALL["live_games"][0](tables).where("state = 'in_game'").select("puuid", "game_id", "participant_puuid")
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
