"""Tables that are switched by a pointer, and what is merged into them."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from riftstats.operators import ingest as I
from riftstats.sources.versioned import VersionedTable, part_name
from riftstats.streaming import matches as S

ROWS = "patch string, id int, v string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", F.col("patch"), ROWS, most_folders=3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_touched_partitions_are_written(spark, table):
    assert table.read().collect() == [] and not table.exists()
    df = spark.createDataFrame([("14.1", 1, "a"), ("14.10", 2, "b"), (None, 3, "c"), ("a/b", 4, "d")], ROWS)
    table.replace(df)
    before = table.pointer()
    assert rows(table.read()) == rows(df)
    table.replace(spark.createDataFrame([("14.10", 5, "e")], ROWS))
    after = table.pointer()
    assert {n for n in after["parts"] if after["parts"][n] != before["parts"].get(n)} == {part_name("14.10")}
    assert rows(table.read([part_name("14.10"), part_name(None)])) == sorted([("14.10", 5, "e"), (None, 3, "c")], key=str)
    assert [r.patch for r in table.read([part_name("14.1")]).collect()] == ["14.1"]


def test_a_stop_before_the_switch_leaves_the_old_table(spark, table, monkeypatch):
    df = spark.createDataFrame([("1", 1, "a"), ("2", 2, "b")], ROWS)
    table.replace(df)
    monkeypatch.setattr(table, "_switch", lambda pointer: (_ for _ in ()).throw(OSError("stopped")))
    new = spark.createDataFrame([("1", 1, "x"), ("3", 3, "c")], ROWS)
    for change in (table.replace, table.append, lambda d: table.merge(d, ["patch", "id"]), table.rewrite):
        with pytest.raises(OSError, match="stopped"):
            change(new)
        assert rows(table.read()) == rows(df)
    monkeypatch.undo()
    assert table.vacuum() == 4 and rows(table.read()) == rows(df)
    table.merge(new, ["patch", "id"])
    assert rows(table.read()) == [("1", 1, "x"), ("2", 2, "b"), ("3", 3, "c")]


def test_a_second_merge_changes_nothing(spark, table):
    table.replace(spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("2", 3, "c"), (None, 4, None)], ROWS))
    new = spark.createDataFrame([("1", 1, "z"), ("1", 9, None), ("2", 3, "c"), (None, 4, None)], ROWS)
    want = rows(I.upserted(table.read(), new, ["patch", "id"]).drop("change"))
    assert table.merge(new, ["patch", "id"]) == {"updated": 1, "inserted": 1, "kept": 1, "same": 2}
    pointer = table.pointer()
    assert len({f.split("/")[0] for f in pointer["parts"]["k1"] + pointer["parts"]["k2"]}) == 2  # 2 had no change
    assert rows(table.read()) == want
    assert table.merge(new, ["patch", "id"]) == {"same": 4, "kept": 1} and table.pointer() == pointer
    assert table.rewrite(table.read()) == [] and table.pointer() == pointer
    assert table.merge(new.where("false"), ["patch", "id"]) == {}


def test_the_newest_of_a_key_counts(spark, table):
    new = spark.createDataFrame([("1", 1, "b"), ("1", 1, "a"), ("1", 1, "c")], ROWS)
    table.merge(new, ["patch", "id"], newest="v")
    assert rows(table.read()) == [("1", 1, "c")]


def test_folders_are_bounded_and_labels_apply_once(spark, table):
    for n in range(9):
        for _ in range(2):  # each batch is run again
            table.append(spark.createDataFrame([("1", n, "a"), (f"x{n}", n, "b")], ROWS), n)
        assert len(table.folders(["k1"])) <= 3
    assert table.read(["k1"]).count() == 9 and table.read().count() == 18 and table.pointer()["label"] == 8


def rank(tier, at):
    return ("p", "q", tier, "I", 1, 1, 1, at)


RANKS = "puuid string, queue_type string, tier string, division string, league_points int, wins int, losses int, updated_at long"


def test_three_observations_give_two_history_rows(spark):
    none = spark.createDataFrame([], RANKS)
    new = spark.createDataFrame([rank("C", 3), rank("A", 1), rank("B", 2)], RANKS)
    assert [(r.tier, r.change) for r in I.upsert_ranks(none, new).collect()] == [("C", "inserted")]
    history = none.drop("updated_at")
    assert sorted(r.tier for r in I.rank_history(none, new, history).collect()) == ["A", "B"]
    now = spark.createDataFrame([rank("A", 0)], RANKS)
    had = spark.createDataFrame([rank("B", 0)], RANKS).drop("updated_at")
    assert [r.tier for r in I.rank_history(now, new, had).collect()] == ["A"]  # A once, B is known
    back = spark.createDataFrame([rank("B", 1), rank("A", 2), rank("A", 3)], RANKS)
    assert sorted(r.tier for r in I.rank_history(now, back, history).collect()) == ["A", "B"]
    assert I.rank_history(now, spark.createDataFrame([rank("A", 5)], RANKS), history).collect() == []


def test_timeline_states_merge_at_every_cut(spark):
    schema = "match_id string, queue_id int, at long, ok boolean"
    logs = [("NA1_1", "fffff"), ("NA1_2", "ffsf"), ("NA1_3", "fff"), ("NA1_4", "ffffs"), ("XX_5", "fs"), ("NA1_6", "s"), ("NA1_7", "fsffff")]
    log = [(m, 440 if m == "NA1_6" else 420, 10 * k, c == "s") for m, text in logs for k, c in enumerate(text)]
    df = spark.createDataFrame(log, schema)
    want = rows(I.fold_timeline_attempts(df))
    assert {r[1] for r in want} == {1, 2, 3, 4}
    assert max(len(r.failed_at) for r in I.timeline_state(df).collect()) == 4
    for cut in range(7):
        a, b = df.where(F.col("at") < 10 * cut), df.where(F.col("at") >= 10 * cut)
        assert rows(I.fold_timeline_attempts(b, state=I.timeline_state(a))) == want
    odd, even = df.where("at % 20 = 0"), df.where("at % 20 <> 0")
    assert rows(I.timeline_status(I.merged_timeline_states([I.timeline_state(even), I.timeline_state(odd)]))) == want


def test_replaced_rows(spark):
    schema = "match_id string, minute_mark int, participant_id int, gold int"
    old = spark.createDataFrame([("a", 15, 1, 1), ("a", 15, 9, 1), ("a", 10, 1, 1), ("b", 15, 1, 1)], schema)
    new = spark.createDataFrame([("a", 15, 1, 5), ("a", 15, 2, 6)], schema)
    assert rows(I.replaced(old, new, ["match_id", "minute_mark"])) == [("a", 10, 1, 1), ("a", 15, 1, 5), ("a", 15, 2, 6), ("b", 15, 1, 1)]


def documents(ids, version):
    body = {"gameCreation": 1, "gameDuration": 9, "queueId": 420, "participantIds": ["p"], "participants": [{"participantId": 1, "puuid": "p", "teamId": 100, "championId": 3, "item0": 7}], "teams": []}
    return [json.dumps(body | {"matchId": f"NA1_{i}"} | ({} if version is None else {"gameVersion": version})) for i in ids]


def test_patches_survive_restarts(spark, tmp_path):
    """14.1, 14.10, 14.20 and none, in batches with repeats, the query started anew
    before each; a batch opens no more folders than before."""
    versions = {0: "14.1.2.3", 1: "14.10.5", 2: "14.20", 3: None, 4: " "}
    sink, opened = f"file://{tmp_path}/sink", []

    def land(checkpoint="state"):
        S.drained(S.new_matches(spark.readStream.text(f"{tmp_path}/in"), sink, f"{tmp_path}/{checkpoint}").start())

    for n in range(12):
        lines = [d for k, v in versions.items() for d in documents([100 * n + k, 100 * max(0, n - 3) + k, 100 * n + k], v)]
        spark.createDataFrame([(d,) for d in lines], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        land()
        ids = S.landing_table(spark, sink, "ids")
        opened.append(len(ids.folders(ids.names_in(ids.read()))))
    got = {r.match_id: r.patch for r in S.landed_table(spark, sink, "matches").collect()}
    assert len(got) == S.landed_table(spark, sink, "matches").count() == 60
    assert got == {f"NA1_{100 * n + k}": p for n in range(12) for k, p in enumerate(["14.1", "14.10", "14.20", None, None])}
    for name in ("participants", "items"):
        assert S.landed_table(spark, sink, name).count() == 60
    assert max(opened) <= 8 and max(len(f) for f in S.landing_table(spark, sink, "matches").pointer()["parts"].values()) <= 8
    land("another")  # all documents once more, known by their ids
    assert S.landed_table(spark, sink, "matches").count() == 60


def test_ids_lie_in_few_parts(spark):
    ids = spark.createDataFrame([("NA1_5000000001",), ("NA1_5000000002",), ("EUW1_5000000001",), ("odd",), ("KR_x",), (None,)], "match_id string")
    got = {r[0]: r[1] for r in ids.select("match_id", S.id_part(F.col("match_id"))).collect()}
    assert got["NA1_5000000001"] == got["NA1_5000000002"] == "NA1-5000" and got["EUW1_5000000001"] == "EUW1-5000"
    assert got["odd"].startswith("x") and got["KR_x"].startswith("x")


def poll_rows():
    return [(f"p{p}", "NA1", ("in_game", "offline", "lobby")[(t + p) % 3], t if t % 2 else None, t * 40_000, t) for p in range(3) for t in range(1, 30)]


POLLED = "puuid string, platform_region string, state string, game_id long, observed_at long, event_id long"


def drain(spark, df, path, late, batches):
    files = [df.where(f"event_id >= {a} and event_id < {b}") for a, b in itertools.pairwise(batches)]
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    for f in files:
        f.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return S.run_to_table(S.live_states(reader.parquet(f"{path}/in"), late), spark, f"{path}/out", f"{path}/state", "update")


def test_due_rows_come_by_timer(spark, tmp_path):
    from riftstats.operators import live as L

    df = spark.createDataFrame(poll_rows(), POLLED)
    late = spark.createDataFrame([("p9", "NA1", "lobby", 1, 1_200_000, 100)], POLLED)  # moves the watermark, later than the others
    got = drain(spark, df.unionByName(late), tmp_path, "0 seconds", [1, 10, 20, 30, 200]).collect()
    now = 1_200_000
    want = L.live_state_latest(df, now).collect()
    last = {}
    for r in sorted(got, key=lambda r: (r.observed_at, r.event_id)):
        if not r.is_due:
            last[r.puuid] = (r.state, r.game_id, r.observed_at, r.next_poll_at)
    assert {k: v for k, v in last.items() if k != "p9"} == {r.puuid: (r.state, r.game_id, r.observed_at, r.next_poll_at) for r in want}
    due = {(r.puuid, r.observed_at) for r in got if r.is_due}
    assert {(r.puuid, r.observed_at) for r in want if r.next_poll_at < now} <= due
    looked = {(p, at): L.POLL_SECONDS.get(s, 300) * 1000 for p, _, s, _, at, _ in poll_rows()}
    assert all(at + looked[p, at] <= now for p, at in due)


def test_states_in_any_order(spark, tmp_path):
    from riftstats.operators import live as L

    df = spark.createDataFrame(poll_rows(), POLLED)
    df.orderBy(F.hash("event_id", "puuid")).repartition(4).write.parquet(f"{tmp_path}/in")
    got = S.run_to_table(S.live_states(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "10 days"), spark, f"{tmp_path}/out", f"{tmp_path}/state", "update")
    last = got.groupBy("puuid").agg(F.max_by(F.struct("state", "game_id", "observed_at"), F.struct("observed_at", "event_id")).alias("s")).collect()
    want = {r.puuid: (r.state, r.game_id, r.observed_at) for r in L.live_state_latest(df, 0).collect()}
    assert {r.puuid: tuple(r.s) for r in last} == want


def test_idle_matches_leave_the_state(spark, tmp_path):
    """Matches are forgotten behind their last attempt; of very many failures no more
    than the limit are kept."""
    schema = "match_id string, at long, ok boolean"
    first = [("idle", k, False) for k in range(40)] + [("live", 5, False)]
    for part in (first, [("live", 100_000, False)], [("live", 200_000, False), ("idle", 200_001, False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        states = S.fetch_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), keep_ms=50_000, late="0 seconds")
        got = S.run_to_table(states, spark, f"{tmp_path}/out", f"{tmp_path}/state", "update")
    seen = {(r.match_id, r.last_attempt_at): r.failures for r in got.collect()}
    assert seen["idle", 39] == 5 and seen["idle", 200_001] == 1  # begun anew
    assert seen["live", 5] == 1 and seen["live", 200_000] == 3  # it has gone on


def test_live_rows_reduce_the_tables_first(spark):
    from riftstats.operators.live import live_participants

    none = lambda ddl: spark.createDataFrame([], ddl)
    live = none("game_id long, team_id int, puuid string, champion_id int")
    plan = live_participants(live, none("puuid string, game_name string, updated_at long, summoner_id long"), none("puuid string, queue_type string, tier string, division string, league_points int"), none("match_id string, status int"), none("match_id string, puuid string, win boolean, kills int, deaths int, assists int"), none("champion_id int, win_rate double, games long"))
    text = plan._jdf.queryExecution().analyzed().toString()
    stats = text[: text.index("recent_win_rate")]
    assert text.count("LeftSemi") >= 4 and stats
    below = text.split("AS recent_kda", 1)[1]
    assert "LeftSemi" in below


def test_partitions_are_compared_without_moving_rows(spark, table, monkeypatch):
    """Repeats, nulls and values that change columns count as other rows; partitions
    are compared by sums, not by a shuffle of both sides."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "exceptAll", None)
    frame = lambda *r: spark.createDataFrame(list(r), ROWS)
    one, none = ("1", 1, "a"), ("1", None, "b")
    table.replace(frame(one, one, none, ("2", 2, None)))
    assert table.rewrite(frame(none, one, one, ("2", 2, None))) == []
    for other in (frame(one, none), frame(one, none, none), frame(one, one, ("1", 0, "b")), frame(one, one, none, one)):
        table.replace(frame(one, one, none))
        assert table.rewrite(other) == ["k1"] and rows(table.read([part_name("1")])) == rows(other)
    assert table.rewrite(frame(("2", None, "2"))) == ["k2"] and table.rewrite(frame(("2", 2, None))) == ["k2"]


def test_replaced_rows_among_some(spark):
    old = spark.createDataFrame([("a", 10, 1, 1), ("a", 15, 1, 1), ("b", None, 1, 1)], "match_id string, minute_mark int, participant_id int, gold int")
    new = spark.createDataFrame([("a", 15, 1, 5)], old.schema)
    got = I.replaced(old, new, ["match_id", "minute_mark"], F.col("minute_mark") == 15)
    assert rows(got) == rows(I.replaced(old, new, ["match_id", "minute_mark"])) == [("a", 10, 1, 1), ("a", 15, 1, 5), ("b", None, 1, 1)]


@pytest.mark.parametrize("name", ["sink_item_versions", "sink_rune_versions", "sink_summoners"])
def test_what_is_merged_is_derived_once(spark, monkeypatch, name):
    """Looks at incoming rows read what was written, not the matches' players again."""
    from riftstats.plans import landing
    from riftstats.sources.fixtures import Tables
    from riftstats.sources.versioned import VersionedTable

    seen, names_in = [], VersionedTable.names_in
    monkeypatch.setattr(VersionedTable, "names_in", lambda table, rows: seen.append(rows.inputFiles()) or names_in(table, rows))
    landing.QUERIES[name][0](Tables(spark, "/root/testdata/sf0.001"))
    assert seen and not [f for files in seen for f in files if "lineitem" in f]


def test_folded_rows_are_derived_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from riftstats.sources.versioned import VersionedTable

    looked = spark.sparkContext.accumulator(0)

    def look(x):
        looked.add(1)
        return x

    table = VersionedTable(spark, f"file://{tmp_path}/t", F.col("k"))
    added = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, n long")
    table.fold(rows, added, 0)
    table.fold(rows.withColumn("n", F.udf(look, "long")("n")), added, 1)
    assert looked.value == 3
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 10)]
