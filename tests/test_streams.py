"""Streams whose rows come from many files, in no order, and in many frames."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riftstats.operators import ingest as I
from riftstats.operators import live as L
from riftstats.operators import players as P
from riftstats.plans.common import rounded
from riftstats.sources import raw as R
from riftstats.sources.fixtures import Tables
from riftstats.streaming import matches as S


@pytest.fixture
def small_frames(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 2)
    yield
    spark.conf.set(key, was)


def stream(df, at, files=None):
    df.write.parquet(f"{at}/in")
    reader = df.sparkSession.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{at}/in")


def log(spark):
    """Attempts of each match, a success now and then, the newest first."""
    rows = [(f"m{m}", 0, t * 10, (t * 7 + m) % (m + 2) == 0) for m in range(12) for t in range(40, 0, -1)]
    return spark.createDataFrame(rows, "match_id string, match_date long, at long, ok boolean")


COLUMNS = ["match_id", "failures", "last_attempt_at", "last_success_at", "status", "next_attempt_at"]


@pytest.mark.parametrize("files", [None, 1])
def test_fetch_state_in_any_order(spark, tmp_path, small_frames, files):
    rows = log(spark)
    want = {tuple(r) for r in I.fold_fetch_attempts(rows, 0).select(*COLUMNS).collect()}
    assert {r[4] for r in want} == {1, 2, 3}
    shuffled = rows.orderBy(F.hash("match_id", "at")).select("match_id", "at", "ok").repartition(5) if files else rows.select("match_id", "at", "ok").repartition(3, "match_id")
    calls = stream(shuffled, tmp_path, files)
    last = {}

    def put(batch, _):
        last.update({r.match_id: tuple(r) for r in batch.select(*COLUMNS).collect()})

    S.drained(S.fetch_state(calls).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(put).start())
    assert set(last.values()) == want


def test_fetch_state_outside_retention(spark, tmp_path):
    day = 86_400_000
    rows = spark.createDataFrame([("old", -731 * day, 0, False), ("new", -729 * day, 0, False)], "match_id string, match_date long, at long, ok boolean")
    got = S.run_to_table(S.fetch_state(stream(rows, tmp_path), 0), spark, f"{tmp_path}/out", f"{tmp_path}/state", "update")
    assert {tuple(r) for r in got.select(*COLUMNS).collect()} == {tuple(r) for r in I.fold_fetch_attempts(rows, 0).select(*COLUMNS).collect()}
    assert {r.match_id: r.status for r in got.collect()} == {"old": 4, "new": 2}


def test_fetch_attempts_go_on_from_a_state(spark):
    rows = log(spark)
    want = sorted(tuple(r) for r in I.fold_fetch_attempts(rows, 0).collect())
    first = I.fold_fetch_attempts(rows.where("at <= 200 and match_id <> 'm3'"), 0)
    assert sorted(tuple(r) for r in I.fold_fetch_attempts(rows, 0, state=first).collect()) == want
    assert sorted(tuple(r) for r in I.fold_fetch_attempts(rows.where("false"), 0, state=I.fold_fetch_attempts(rows, 0)).collect()) == want


def snapshots(spark):
    rows = [(f"p{p}", "NA1", ("in_game", "offline", "lobby")[(t * t + p) % 3 if t % 4 else 1], t // 3, t * 10, t) for p in range(5) for t in range(60, 0, -1)]
    return spark.createDataFrame(rows, "puuid string, platform_region string, state string, game_id long, observed_at long, event_id long")


def test_game_ended_in_any_order(spark, tmp_path, small_frames):
    rows = snapshots(spark)
    want = sorted(tuple(r) for r in L.live_game_ended(rows).select("puuid", "platform_region", "ended_game_id", "observed_at").collect())
    got = S.game_ended(stream(rows.repartition(5), tmp_path), f"{tmp_path}/out", f"{tmp_path}/state")
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == want


def test_game_ended_over_batches(spark, tmp_path):
    at = [("a", 1, "in_game", 7, 10), ("a", 2, "offline", 0, 30), ("b", 3, "in_game", 8, 10), ("a", 4, "in_game", 9, 20), ("b", 5, "offline", 0, 40), ("b", 6, "lobby", 0, 5)]
    for n, part in enumerate((at[:3], at[3:])):  # the older rows of the second batch are dropped
        df = spark.createDataFrame([(p, "NA1", state, game, when, e) for p, e, state, game, when in part], snapshots(spark).schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = S.game_ended(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
        assert sorted(tuple(r) for r in got.collect()) == [("a", "NA1", 7, 30), ("b", "NA1", 8, 40)][: n + 1]


def test_game_ended_waits_for_late_rows(spark, tmp_path):
    """Rows that come in another order, over three batches, within the delay."""
    rows = snapshots(spark)
    want = sorted(tuple(r) for r in L.live_game_ended(rows).select("puuid", "platform_region", "ended_game_id", "observed_at").collect())
    for n in range(3):
        rows.where(F.pmod(F.hash("event_id"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = S.game_ended(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", delay_ms=10_000)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_game_ended_without_rows(spark, tmp_path):
    df = snapshots(spark).where("false")
    df.write.parquet(f"{tmp_path}/in")
    assert S.game_ended(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").count() == 0


def test_landed_tables_serve_player_statistics(spark, tmp_path):
    """Raw matches landed by the stream, in two batches with repeats, give the same
    statistics as the tables that they were rendered from."""
    t = Tables(spark, "/root/testdata/sf0.001")
    docs = R.render(t.matches, t.participants, t.bans, t.items, t.runes).select("value")
    docs.where("hash(value) % 2 = 0").unionByName(docs.where("hash(value) % 3 = 0")).coalesce(1).write.text(f"{tmp_path}/in")
    land = lambda: S.drained(S.new_matches(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/sink", f"{tmp_path}/state", t.summoners.select("puuid")).start())
    land()
    docs.where("hash(value) % 2 <> 0").unionByName(docs.where("hash(value) % 5 = 0")).coalesce(1).write.mode("append").text(f"{tmp_path}/in")
    land()
    matches, people = (S.landed_table(spark, f"{tmp_path}/sink", x) for x in ("matches", "participants"))
    assert matches.count() == matches.select("match_id").distinct().count() == t.participants.select("match_id").distinct().count()
    blank = "not (match_key % 71 = 0 and participant_id = 1)"
    plain = lambda df: sorted(map(str, rounded(df).collect()))
    every = t.matches.where("queue_id <> 0").withColumn("status", F.lit(1))  # queues as text are an older form of stored rows
    assert plain(P.player_overview(matches, people)) == plain(P.player_overview(every, t.participants.where(blank)))
    own = t.items.join(t.participants.select("match_id", "participant_id"), ["match_id", "participant_id"])
    assert S.landed_table(spark, f"{tmp_path}/sink", "items").count() == own.count()


def test_a_retried_batch_writes_once(spark, tmp_path):
    df = spark.range(10)
    query = stream(df, tmp_path)
    got = S.run_to_table(query, spark, f"{tmp_path}/out", f"{tmp_path}/state", "append")
    assert got.count() == 10
    again = S.run_to_table(query, spark, f"{tmp_path}/out", f"{tmp_path}/state2", "append")  # the same batch once more
    assert again.count() == 10


def test_all_failures_are_counted(spark, tmp_path):
    """Also those beyond the limit, over several batches and parts of ids, where the
    watermark has turned earlier ones into a number and a success comes later on."""
    parts = [[(f"NA1_{m}", m * 100 + k, False) for m in (1, 5000, 9) for k in range(8)] + [("odd", 7, False)], [("NA1_1", 1_000_000, False), ("odd", 1_000_001, False)], [("NA1_1", 1_000_500, True), ("NA1_1", 1_000_501, False), ("NA1_9", 1_000_600, False)]]
    schema = "match_id string, at long, ok boolean"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        calls = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = S.run_to_table(S.fetch_state(calls, keep_ms=10**9, late="0 seconds", every=True), spark, f"{tmp_path}/out", f"{tmp_path}/state", "update")
    rows = spark.createDataFrame([r for p in parts for r in p], schema).withColumn("match_date", F.lit(0).cast("long"))
    want = {r.match_id: tuple(r) for r in I.fold_fetch_attempts(rows, 0, every=True).select(*COLUMNS).collect()}
    last = {}
    for r in got.orderBy("batch").select(*COLUMNS).collect():
        last[r.match_id] = tuple(r)
    assert last == want and {k: v[1] for k, v in want.items()} == {"NA1_1": 1, "NA1_5000": 8, "NA1_9": 9, "odd": 2}


def test_packed_rows_render_as_documents(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    drafts = t.drafts.withColumn("patch", F.when(F.col("match_key") % 3 > 0, F.col("patch")))  # some documents have no version
    want, got = R.documents(drafts, t.players), R.rendered(R.packed(drafts, t.players))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def document(n, copy=0):
    """A match of ten players, two of whom are unknown (one of them everywhere), and one blank."""
    people = [{"participantId": i + 1, "puuid": " " if i == 4 else "new" if i == 7 else f"new{n}" if i == 8 else f"P{i}", "teamId": 100, "championId": 1 + i, "kills": copy, "item0": 1001, "perks": {"styles": [], "statPerks": {"offense": 5001, "flex": 5002, "defense": 5003}}} for i in range(10)]
    return json.dumps({"matchId": f"NA1_{n}", "gameCreation": n, "gameVersion": f"14.{n % 3}.1", "participants": people, "teams": []})


def disk(at):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(at) for f in files)


def test_landing_leaves_the_tables_only(spark, tmp_path):
    """Raw rows of a batch go when its tables are there, and no document is dealt out:
    of a batch that repeats its matches, little more than their ids is shuffled."""
    known = spark.createDataFrame([(f"P{i}",) for i in range(10)], "puuid string")
    docs = [document(n) for n in range(600)]
    status = spark.sparkContext._jsc.sc().statusStore()
    for part in (docs[:400] + docs[:300], docs[200:]):
        spark.createDataFrame([(x,) for x in part], "value string").repartition(3).write.mode("append").text(f"{tmp_path}/in")
        began = status.executorList(False).apply(0).totalShuffleWrite()
        S.drained(S.new_matches(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/sink", f"{tmp_path}/state", known).start())
        assert status.executorList(False).apply(0).totalShuffleWrite() - began < disk(f"{tmp_path}/in") / 10
    assert not os.path.exists(f"{tmp_path}/sink/raw/batch=0") and not os.path.exists(f"{tmp_path}/sink/raw/batch=1")
    matches, people, runes = (S.landed_table(spark, f"{tmp_path}/sink", x) for x in ("matches", "participants", "runes"))
    assert sorted(r.match_id for r in matches.collect()) == sorted(f"NA1_{n}" for n in range(600))
    assert people.count() == 600 * 9 and runes.count() == 600 * 30 and "in_part" not in runes.columns
    assert {r.puuid for r in people.where("is_stub").collect()} == {"new", *(f"new{n}" for n in range(600))}


def test_a_landed_batch_run_again_changes_nothing(spark, tmp_path):
    """Also where the batch before it broke off between its tables, with raw rows there."""
    spark.createDataFrame([(document(n % 50, n // 50),) for n in range(120)], "value string").repartition(3).write.text(f"{tmp_path}/in")
    land = lambda state: S.drained(S.new_matches(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/sink", f"{tmp_path}/{state}").start())
    rows = lambda: {name: sorted(map(str, S.landed_table(spark, f"{tmp_path}/sink", name).collect())) for name in ("matches", "participants", "runes", "items", "bans")}
    land("a")
    once = rows()
    assert len(once["matches"]) == 50 and len(once["participants"]) == 450 and all("is_stub=True" in r for r in once["participants"])
    land("b")
    assert rows() == once
    for name in ("ids", "items"):  # these weren't reached
        os.remove(f"{tmp_path}/sink/{name}/CURRENT")
        crc = f"{tmp_path}/sink/{name}/.CURRENT.crc"
        if os.path.exists(crc):
            os.remove(crc)
    os.makedirs(f"{tmp_path}/sink/raw/batch=0/rows")
    land("c")
    assert rows() == once and not os.path.exists(f"{tmp_path}/sink/raw/batch=0")
