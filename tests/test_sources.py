"""A database as a source, and tables in buckets."""

import re

import pytest
from pyspark.sql import functions as F

from riftstats.operators import champions as C
from riftstats.operators import players as P
from riftstats.operators.ingest import timeline_snapshots
from riftstats.sources.bucketed import BY_MATCH, by_match, write_buckets
from riftstats.sources.fixtures import Tables
from riftstats.sources.jdbc import Source
from riftstats.sources.versioned import VersionedTable

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def source(spark, tmp_path):
    """The embedded database that comes with Spark, with keys of uneven density."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(400).select((F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") * 1000)).alias("K"), F.concat(F.lit("v"), "id").alias("V"))
    df.write.jdbc(url, "HELD", properties={"driver": DRIVER})
    return Source(spark, url, driver=DRIVER)


def test_ranges_are_of_equal_size(source):
    ranges = source.ranges("HELD", "K", 8)
    sizes = [source.where("HELD", [p]).count() for p in ranges]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) <= 60
    assert source.table("HELD", "K", 8).select("K").distinct().count() == 400
    assert source.ranges("HELD", "K", 4, above=10**9) == []


def test_filters_and_columns_reach_the_database(source):
    plan = source.table("HELD", "K", 4).where("V = 'v7'").select("K")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(V), *EqualTo(V,v7)]" in plan and re.search(r"ReadSchema: struct<K:\w+>", plan)


def test_two_runs_read_each_row_once(spark, source, tmp_path, monkeypatch):
    sink = VersionedTable(spark, f"file://{tmp_path}/sink")
    with monkeypatch.context() as m:
        m.setattr(sink, "_switch", lambda p: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            source.land_new("HELD", "K", sink, 3)
    assert source.land_new("HELD", "K", sink, 3) == 399_000
    assert source.land_new("HELD", "K", sink, 3) is None
    spark.createDataFrame([(400_000, "new"), (400_007, "new")], "K long, V string").write.mode("append").jdbc(source.url, "HELD", properties={"driver": DRIVER})
    assert source.land_new("HELD", "K", sink, 3) == 400_007
    got = sink.read()
    assert got.count() == got.select("K").distinct().count() == 402


@pytest.fixture(scope="module")
def bucketed(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    keys = [f"spark.sql.{k}" for k in ("requireAllClusterKeysForCoPartition", "sources.bucketing.autoBucketedScan.enabled", "autoBroadcastJoinThreshold", "adaptive.enabled")]
    was = {k: spark.conf.get(k) for k in keys}
    spark.sql("CREATE DATABASE IF NOT EXISTS landed")
    for name in BY_MATCH:
        write_buckets(getattr(t, name), "landed", name, 4, t.matches)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield t, {name: by_match(spark, "landed", name) for name in BY_MATCH}
    for k, v in was.items():
        spark.conf.set(k, v)
    spark.sql("DROP DATABASE landed CASCADE")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_without_exchange(df, names):
    """Whether no exchange lies between the scans of these tables and the first
    aggregate (or window or the root) above them."""
    lines = plan(df).splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-*()0123456789"))
    bad = []
    for i, line in enumerate(lines):
        found = re.search(r"Scan parquet .*?(\w+)_by_match", line)
        if not found or found[1] not in names:
            continue
        at = depth(line)
        for above in reversed(lines[:i]):
            if depth(above) < at:
                at = depth(above)
                if "Exchange" in above:
                    bad.append((found[1], above.strip()))
                    break
                if "Aggregate" in above:
                    break
    return bad


def test_joins_by_match_need_no_exchange(bucketed):
    t, b = bucketed
    rows = C.ranked_rows(b["matches"], b["participants"])
    assert "Exchange" not in plan(rows)
    detail = P.match_detail(b["matches"], b["participants"], b["items"], b["runes"], t.rune_versions)
    assert scans_without_exchange(detail, {"matches", "participants", "items"}) == []
    units = C.unit_win_percents(b["matches"], b["participants"], b["items"], b["runes"], t.ranks)
    assert scans_without_exchange(units, {"items", "runes"}) == []  # the rows themselves look up the players' ranks first
    snap = timeline_snapshots(b["matches"], b["participants"], b["frames"]).join(b["matches"].select("match_id", (F.col("match_date") + 1).alias("derived_at")), "match_id")
    lanes = C.lane_matchups(b["matches"], b["participants"], snap, None, None, 30)
    assert scans_without_exchange(lanes, {"matches", "participants", "frames"}) == []
    frames = b["frames"].withColumn("gold", F.col("total_gold"))
    joined = C.ranked_rows(b["matches"], b["participants"]).join(frames.select("match_id", "participant_id", "gold"), ["match_id", "participant_id"], "left").join(b["bans"].select("match_id").distinct(), "match_id", "left_semi")
    assert "Exchange" not in plan(joined)


def test_bucketed_tables_give_the_same(spark, bucketed):
    t, b = bucketed
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert same(C.champion_winrates(b["matches"], b["participants"], b["bans"], t.ranks, 45), C.champion_winrates(t.matches, t.participants, t.bans, t.ranks, 45))
    assert same(P.player_overview(b["matches"], b["participants"]).select("puuid", "games", "wins"), P.player_overview(t.matches, t.participants).select("puuid", "games", "wins"))
