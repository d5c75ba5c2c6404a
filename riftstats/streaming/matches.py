"""Streaming forms of ingestion and live states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.exprs import OUTSIDE_RETENTION, PERMANENT_FAILURE, SUCCESS, TEMPORARY_FAILURE
from ..operators import ingest as I
from ..operators.ingest import DAY, MATCH_DELAYS, MAX_MATCH_FAILURES, RETENTION_DAYS, short_patch
from ..operators.live import OTHER_POLL_SECONDS, POLL_SECONDS, live_participants
from ..sources import raw as R
from ..sources.storage import discard, lean
from ..sources.versioned import IN_PART, VersionedTable, part_names


def landed(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame | None:
    """A folder of batches, None (or an empty table of `ddl`) if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], ddl) if ddl else None


#: Numbers of matches whose ids are kept together, and parts of ids without a number.
IDS_TOGETHER, ID_PARTS = 1_000_000, 64


def id_part(match_id: F.Column) -> F.Column:
    """The part of the landed ids that an id belongs to: its platform and the range
    of its number. Ids of new matches lie close together, so a batch meets few
    parts, however many matches have landed before."""
    number = F.regexp_extract(match_id, "^([A-Za-z0-9]+)_([0-9]{1,15})$", 2)
    near = F.concat_ws("-", F.regexp_extract(match_id, "^([A-Za-z0-9]+)_", 1), F.floor(number.cast("long") / IDS_TOGETHER))
    return F.when(number != "", near).otherwise(F.concat(F.lit("x"), F.pmod(F.xxhash64(match_id), F.lit(ID_PARTS)).cast("string")))


#: Tables that new_matches lands; all but the ids are partitioned by patch.
LANDED = ("matches", "participants", "runes", "items", "bans")


def landing_table(spark: SparkSession, sink: str, name: str) -> VersionedTable:
    if name == "ids":
        return VersionedTable(spark, f"{sink}/ids", id_part(F.col("match_id")), "match_id string", codec="zstd")
    return VersionedTable(spark, f"{sink}/{name}", F.col("patch"), codec="zstd")


class Staged:
    """A batch of raw rows (patch, m) as they come, each with a number, in the folder
    `at`, and which of them are new: a bit each, so that whole documents needn't be
    dealt out to find repeats, and each table reads just its own fields of them."""

    #: Rows whose bits are a number.
    TOGETHER = 64

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def _all(self, schema: str) -> DataFrame:
        return self.spark.read.schema(f"n bigint, patch string, m struct<{schema}>").parquet(f"{self.at}/rows")

    def put(self, batch: DataFrame, ids: VersionedTable) -> None:
        """Stages a batch. New is the first row of each match that ids don't have."""
        write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        write(batch.withColumn("n", F.monotonically_increasing_id()), "rows")
        seen = self._all("matchId string").select("n", F.col("m.matchId").alias("match_id"))
        new = seen.groupBy("match_id").agg(F.min("n").alias("n")).join(ids.read(ids.names_in(seen)), "match_id", "left_anti")
        bit = F.expr(f"shiftleft(1L, cast(n % {self.TOGETHER} as int))")
        write(new.groupBy(F.expr(f"n div {self.TOGETHER}").alias("w")).agg(F.bit_or(bit).alias("bits")), "new")

    def read(self, schema: str) -> DataFrame:
        """The new rows, with some fields of theirs and the name of their patch's partition."""
        new = self.spark.read.schema("w bigint, bits bigint").parquet(f"{self.at}/new")
        rows = self._all(schema).withColumn("w", F.expr(f"n div {self.TOGETHER}")).join(F.broadcast(new), "w")
        return rows.where(f"getbit(bits, cast(n % {self.TOGETHER} as int)) = 1").select("patch", part_names(F.col("patch")).alias(IN_PART), "m")

    def unknown(self, known: DataFrame) -> DataFrame:
        """The new rows' players who aren't known, written once: few, as a rule."""
        I.unknown_players(self.read("participants array<struct<puuid: string>>"), known).write.mode("overwrite").parquet(f"{self.at}/unknown")
        return self.spark.read.schema("puuid string").parquet(f"{self.at}/unknown")


def new_matches(lines: DataFrame, sink: str, checkpoint: str, known: DataFrame | None = None) -> DataStreamWriter:
    """Raw match lines to the sink's tables matches, participants, runes, items and
    bans, each match once, however old: repeats within a batch collapse, others
    meet the ids that earlier batches landed in the same parts, so no state grows
    and nothing is late. known: players so far; others become stubs, blank ones are
    dropped. A match without a version has no patch (null).

    A batch's raw rows are written first, as they come, and everything is made from
    them; they are removed when all of it is there. The ids come last; a batch that is
    run again overwrites its raw rows, which are the same, and passes over the tables
    that it has reached. Folders of a partition are rewritten as one from time to
    time, so a batch opens a bounded number."""
    rows = R.parse(lines).select(short_patch(F.col("m.gameVersion")).alias("patch"), "m")

    def land(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        staged = Staged(spark, f"{sink}/raw/batch={n}")
        ids = landing_table(spark, sink, "ids")
        if ids.pointer()["label"] < n:
            staged.put(batch, ids)
            # without known players all are unknown, which takes no look at them
            unknown = staged.unknown(known) if known is not None else None
            nobody = spark.range(0).select(F.col("id").cast("string").alias("puuid"))
            put = lambda df, name: landing_table(spark, sink, name).append(df, n)
            put(I.match_facts(staged.read(R.FACTS_READ), nobody, "lenient", unknown).drop("match_date", "duration", "queue_id", "end_of_game_result"), "participants")
            put(I.participant_runes(staged.read(R.RUNES_READ), "patch", IN_PART), "runes")
            put(I.participant_items(staged.read(R.ITEMS_READ), "patch", IN_PART), "items")
            put(I.match_bans(staged.read(R.BANS_READ), "patch", IN_PART), "bans")
            put(I.match_headers(staged.read(R.HEADS_READ)), "matches")
            ids.append(staged.read("matchId string").select("m.matchId").toDF("match_id"), n)
        discard(spark, staged.at)

    def land_leanly(batch: DataFrame, n: int) -> None:
        with lean(batch.sparkSession):
            land(batch, n)

    return rows.writeStream.foreachBatch(land_leanly).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def landed_table(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """One of the sink's tables. Participants, items and bans are partitioned by
    their match's patch, which isn't a column of theirs."""
    df = landing_table(spark, sink, name).read()
    return df.drop("patch") if name in ("participants", "items", "bans") else df


def with_state_store(spark: SparkSession) -> None:
    """Operators with timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def after_epoch(ms: str) -> F.Column:
    """Epoch milliseconds as a time above the watermark that a stream begins with,
    which is the epoch: rows up to it would count as late."""
    return F.timestamp_millis(F.greatest(F.col(ms), F.lit(1)))


#: Numbers of matches whose states are kept together, and the last ones of ids without a number.
STATES_TOGETHER, STATE_PARTS = 4096, 65536
STATE = "match_id array<string>, match_date array<long>, last array<long>, good array<long>, failures array<long>, of array<int>, failed_at array<long>"
OUT = "match_id string, failures int, last_attempt_at long, last_success_at long, status int, next_attempt_at long"


def state_part(match_id: F.Column) -> F.Column:
    """The part of the states that an id belongs to: the range of its number, so that
    parts grow in number with the matches, not in size."""
    number = F.regexp_extract(match_id, "_([0-9]{1,15})$", 1)
    return F.when(number != "", F.concat(F.lit("n"), F.floor(number.try_cast("long") / STATES_TOGETHER))).otherwise(F.concat(F.lit("x"), F.pmod(F.xxhash64(match_id), F.lit(STATE_PARTS))))


class FetchState(StatefulProcessor):
    """Folds the attempts of the matches of a part at once; forgets a match keep_ms
    behind its last one. Failures up to the watermark, which no row can precede any
    more, are a number; later ones keep their times, as a success may still come
    between them."""

    def __init__(self, now_ms: int | None, keep_ms: int, most: int, every: bool):
        self.now_ms, self.keep_ms, self.most, self.every = now_ms, keep_ms, most, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", STATE)

    def load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Matches (match_date, last, good, failures by match_id) and the failures with times."""
        got = self.state.get() if self.state.exists() else ([],) * 7
        ids = pd.Index(list(got[0]), dtype=object, name="match_id")
        known = pd.DataFrame({c: pd.array(list(v), "Int64") for c, v in zip(("date", "last", "good", "failures"), got[1:5], strict=True)}, index=ids)
        return known, pd.DataFrame({"match_id": ids.to_numpy()[np.array(list(got[5]), np.int64)], "at": np.array(list(got[6]), np.int64)})

    def keep(self, known: pd.DataFrame, failed: pd.DataFrame) -> None:
        plain = lambda c: [None if pd.isna(v) else int(v) for v in known[c]]
        self.state.update((list(known.index), *map(plain, ("date", "last", "good", "failures")), known.index.get_indexer(failed["match_id"]).tolist(), failed["at"].tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(known["last"].min()) + self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, failed = self.load()
        new = pd.concat(list(rows), ignore_index=True)
        at = new["at"].astype("int64")
        ok = new["ok"].astype(bool)
        seen = pd.DataFrame({"last": at.groupby(new["match_id"]).max().astype("Int64")})
        seen["good"] = at[ok].groupby(new["match_id"][ok]).max().astype("Int64")
        seen["date"] = new["match_date"].astype("Int64").groupby(new["match_id"]).max() if self.now_ms is not None else pd.array([None] * len(seen), "Int64")
        both = pd.concat([known, seen])
        before = known["good"].copy()
        known = both.groupby(level=0)[["date", "last", "good"]].max().join(known["failures"]).fillna({"failures": 0})
        # failures that are a number precede every success that is new
        newer = known["good"].notna() & (known["good"] > before.reindex(known.index)).fillna(before.reindex(known.index).isna()).astype(bool)
        known.loc[newer, "failures"] = 0
        failed = pd.concat([failed, pd.DataFrame({"match_id": new["match_id"][~ok], "at": at[~ok]})], ignore_index=True)
        good = known["good"].reindex(failed["match_id"]).reset_index(drop=True)
        failed = failed[(good.isna() | (failed["at"] > good).fillna(False)).to_numpy(bool)]
        settled = np.maximum(failed["at"], 1) <= timerValues.getCurrentWatermarkInMs()
        known["failures"] = known["failures"].add(failed[settled].groupby("match_id").size(), fill_value=0).astype("Int64")
        failed = failed[~settled]
        total = known["failures"].add(failed.groupby("match_id").size(), fill_value=0).astype("int64").loc[seen.index]
        self.keep(known, failed)
        out = known.loc[seen.index]
        n = total.to_numpy()
        status = np.where(n == 0, SUCCESS, np.where(n >= self.most, PERMANENT_FAILURE, TEMPORARY_FAILURE))
        if self.now_ms is not None:
            status = np.where((self.now_ms - out["date"] > RETENTION_DAYS * DAY).fillna(False).to_numpy(bool), OUTSIDE_RETENTION, status)
        wait = np.array(MATCH_DELAYS)[np.clip(n, 1, len(MATCH_DELAYS)) - 1] * 1000
        yield pd.DataFrame({"match_id": out.index.to_numpy(), "failures": (n if self.every else np.minimum(n, self.most)).astype(np.int32), "last_attempt_at": out["last"].to_numpy(np.int64), "last_success_at": out["good"].array, "status": status.astype(np.int32), "next_attempt_at": (out["last"] + wait).where(status == TEMPORARY_FAILURE).array})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, failed = self.load()
        known = known[(known["last"] + self.keep_ms > timerValues.getCurrentWatermarkInMs()).to_numpy(bool)]
        if len(known):
            self.keep(known, failed[failed["match_id"].isin(known.index)])
        else:
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def fetch_state(attempts: DataFrame, now_ms: int | None = None, keep_ms: int = RETENTION_DAYS * DAY, late: str = "7 days", most: int = MAX_MATCH_FAILURES, every: bool = False) -> DataFrame:
    """State of each match after each batch of attempts (match_id, at, ok, and with
    now_ms, which puts old matches outside of retention, match_date), whatever
    the order in which they come up to `late` behind the newest; older ones are
    dropped. Failures are told up to `most`, which is final, or all with `every`.
    Kept of a match are the last success, the latest attempt, the failures after the
    success (times of the last `late`, a number of the others); all is forgotten once
    the watermark is keep_ms behind its last attempt. Matches of near numbers are
    one key, so that a batch takes few calls of Python."""
    with_state_store(attempts.sparkSession)
    timed = attempts.withColumn("_at", after_epoch("at")).withWatermark("_at", late).withColumn("_part", state_part(F.col("match_id")))
    return timed.groupBy("_part").transformWithStateInPandas(FetchState(now_ms, keep_ms, most, every), OUT, "update", "EventTime")


SEEN = "state string, game_id long, observed_at long, event_id long"
POLL = "puuid string, platform_region string, state string, game_id long, observed_at long, event_id long, next_poll_at long, is_due boolean"


class LivePolls(StatefulProcessor):
    """Keeps each player's latest observation, with a timer for the next look."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", SEEN)

    def row(self, key: tuple, last: tuple, due: bool) -> pd.DataFrame:
        state, game, at, event = last
        return pd.DataFrame({"puuid": [key[0]], "platform_region": [key[1]], "state": [state], "game_id": pd.array([game], "Int64"), "observed_at": [at], "event_id": [event], "next_poll_at": [self.next(last)], "is_due": [due]})

    @staticmethod
    def next(last: tuple) -> int:
        return last[2] + POLL_SECONDS.get(last[0], OTHER_POLL_SECONDS) * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = tuple(self.last.get()) if self.last.exists() else None
        last = was
        for f in rows:
            f = f.sort_values(["observed_at", "event_id"]).iloc[-1]
            new = (f["state"], None if pd.isna(f["game_id"]) else int(f["game_id"]), int(f["observed_at"]), int(f["event_id"]))
            if last is None or new[2:] > last[2:]:
                last = new
        if last != was:
            if was is not None:
                self.handle.deleteTimer(self.next(was))
            self.last.update(last)
            self.handle.registerTimer(self.next(last))
            yield self.row(key, last, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            yield self.row(key, tuple(self.last.get()), True)

    def close(self) -> None:
        pass


def live_states(snapshots: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Each player's latest observation whenever it changes (is_due false), in
    whatever order rows come up to `late` behind the newest, and again when the
    watermark passes its next_poll_at before a newer one has come (is_due true).
    One row a player is kept."""
    with_state_store(snapshots.sparkSession)
    timed = snapshots.withColumn("_at", after_epoch("observed_at")).withWatermark("_at", late)
    return timed.groupBy("puuid", "platform_region").transformWithStateInPandas(LivePolls(), POLL, "update", "EventTime")


def live_enriched(games: DataFrame, path: str, checkpoint: str, summoners: DataFrame, ranks: DataFrame, matches: DataFrame, participants: DataFrame, winrates: DataFrame) -> DataStreamWriter:
    """A stream of live games' players (game_id, team_id, puuid, champion_id) beside
    tables: each batch is written with what live_participants adds, for which ranks
    and statistics are reduced to the batch's players first. A batch that is run
    again overwrites what it wrote."""

    def put(batch: DataFrame, n: int) -> None:
        live_participants(batch, summoners, ranks, matches, participants, winrates).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return games.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def arrivals(matches: DataFrame, width: str = "30 minutes", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Fetched matches of each patch in sliding windows of their fetch time."""
    timed = matches.where("status = 1").withColumn("at", F.timestamp_millis("fetched_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width, slide), "patch").agg(F.count("*").alias("arrivals")).select(F.unix_millis("window.start").alias("window_start"), "patch", "arrivals")


LAST = ["puuid", "platform_region", "state", "game_id", "observed_at"]


def transitions(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The rows behind each player's last row in order of time, each with the state
    and game before it; `_next` is null on the newest."""
    both = rows.withColumn("_new", F.lit(1)).unionByName(last.withColumn("event_id", F.lit(None).cast(rows.schema["event_id"].dataType)).withColumn("_new", F.lit(0)))
    order = Window.partitionBy("puuid", "platform_region").orderBy("_new", "observed_at", "event_id")
    return both.withColumns({"_was": F.lag("state").over(order), "_game": F.lag("game_id").over(order), "_next": F.lead("_new").over(order)})


def ends(rows: DataFrame) -> DataFrame:
    return rows.where("_was = 'in_game' and state = 'offline'").select("puuid", "platform_region", F.col("_game").cast("long").alias("ended_game_id"), "observed_at")


def game_ended(snapshots: DataFrame, path: str, checkpoint: str, delay_ms: int = 0, keep_ms: int = 30 * DAY) -> DataFrame:
    """Drains snapshots and returns the transitions from a game to offline. The
    watermark is the newest observation of earlier batches less `delay_ms`: rows
    older than it are dropped, rows up to the new one are put in order behind the
    player's last row, later ones wait in a table. What waits at the end is put in
    order for the result only. Players without a row for keep_ms behind the
    watermark are forgotten. A batch that is run again overwrites what it wrote."""
    spark = snapshots.sparkSession

    def state(n: int) -> tuple[int | None, DataFrame, DataFrame]:
        mark = spark.read.parquet(f"{checkpoint}/mark/n={n}").first().mark
        return mark, spark.read.parquet(f"{checkpoint}/last/{n}"), spark.read.parquet(f"{checkpoint}/pending/{n}")

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.select(*LAST, "event_id")
        mark, last = None, rows.select(*LAST).where("false")
        if n:
            mark, last, pending = state(n - 1)
            rows = (rows if mark is None else rows.where(F.col("observed_at") >= mark)).unionByName(pending)
        newest = rows.agg(F.max("observed_at").alias("x")).first().x
        mark = max((x for x in (mark, None if newest is None else newest - delay_ms) if x is not None), default=None)
        ready = rows.where(F.lit(False) if mark is None else F.col("observed_at") <= mark)
        waiting = rows.where(F.lit(True) if mark is None else F.col("observed_at") > mark)
        seen = transitions(ready, last)
        ends(seen).write.mode("overwrite").parquet(f"{path}/batch={n}")
        seen.where(F.col("_next").isNull() & (F.col("observed_at") >= (mark or 0) - keep_ms)).select(*LAST).write.mode("overwrite").parquet(f"{checkpoint}/last/{n}")
        waiting.write.mode("overwrite").parquet(f"{checkpoint}/pending/{n}")
        spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{checkpoint}/mark/n={n}")

    drained(snapshots.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start())
    marks = landed(spark, f"{checkpoint}/mark")
    if marks is None:
        return ends(transitions(*(spark.createDataFrame([], snapshots.select(*c).schema) for c in ([*LAST, "event_id"], LAST))))
    _, last, pending = state(marks.agg(F.max("n").alias("n")).first().n)
    return spark.read.parquet(path).drop("batch").unionByName(ends(transitions(pending, last)))


def drained(query: StreamingQuery) -> None:
    """Waits until a query that reads what is there has ended."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_to_table(df: DataFrame, spark: SparkSession, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Drains a streaming DataFrame to parquet and reads the result back, with the
    number of its batch. A batch that is run again overwrites what it wrote."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    drained(df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start())
    return spark.read.parquet(path)
