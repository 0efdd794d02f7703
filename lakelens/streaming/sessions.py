"""Sessions and budgets as state: what is kept for each key, and timers that end it.

`sessions` closes a session when it has been idle for longer than the gap, or when its scope
changes; `spend` gives every run a verdict by what its key has spent on the run's day so far. Rows
may come in any order within the watermark: they wait in the state until the watermark has passed
them, and are then taken in the order of their time and id, so that a stream gives what the batch
functions give over the same rows, without those that came too late. The state of a key is what
waits and one open session, or one day's sum, and is dropped when its timer fires.

Streams need the state store that timers ask for (`state_store`). Rows without a key or a time are
left out by both.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAITING = "at long, run_id string, scope string, cents long"
OPEN = "start long, last long, scope string, runs long, cents long"
SESSIONS = "session_id string, start timestamp, end timestamp, scope string, runs long, cents long"
VERDICTS = "session_id string, run_id string, ts timestamp, spent long, allowed boolean"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rows(runs: DataFrame) -> DataFrame:
    """session_id, run_id, ts, scope and cents as both ways read them (runs: session_id, run_id, ts, scope, cost)."""
    cents = F.round(F.coalesce("cost", F.lit(0.0)) * 100).cast("long")
    return runs.filter("session_id is not null and ts is not null").select(F.col("session_id").cast("string").alias("session_id"), F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("scope", F.lit("")).alias("scope"), cents.alias("cents"))


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _Waiting(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them; `taken` then gets them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, parts: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), str(r), str(s), int(c)) for t, r, s, c in zip(at, part["run_id"], part["scope"], part["cents"], strict=True)])
            for t in sorted(set(at.tolist())):
                self.handle.registerTimer(int(t) // 1000 + 1)
        yield from ()

    def ready(self, until: int) -> list[tuple]:
        """What the watermark (in milliseconds) has passed, in order; the rest goes on waiting."""
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in held if x[0] // 1000 < until)
        left = [x for x in held if x[0] // 1000 >= until]
        if due:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        return due

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.taken(key[0], self.ready(timerValues.getCurrentWatermarkInMs()), timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Sessions(_Waiting):
    columns = ("session_id", "start", "end", "scope", "runs", "cents")

    def __init__(self, gap: timedelta) -> None:
        self.gap = int(gap.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", OPEN)

    def taken(self, key: str, due: list[tuple], until: int) -> list[tuple]:
        now, out = tuple(self.open.get()) if self.open.exists() else None, []
        ended = lambda s: (key, _time(s[0]), _time(s[1]), s[2], s[3], s[4])
        for at, _, scope, cents in due:
            if now and (at - now[1] > self.gap or scope != now[2]):
                out.append(ended(now))
                now = None
            now = (now[0], at, scope, now[3] + 1, now[4] + cents) if now else (at, at, scope, 1, cents)
        if now and (now[1] + self.gap) // 1000 < until:  # no row that is still to come can go on with it
            out.append(ended(now))
            now = None
        if now:
            self.open.update(now)
            self.handle.registerTimer((now[1] + self.gap) // 1000 + 1)
        elif self.open.exists():
            self.open.clear()
        return out


class _Spend(_Waiting):
    columns = ("session_id", "run_id", "ts", "spent", "allowed")

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.day = handle.getValueState("day", "day long, cents long")

    def taken(self, key: str, due: list[tuple], until: int) -> list[tuple]:
        day, spent = tuple(self.day.get()) if self.day.exists() else (-1, 0)
        out = []
        for at, run, _, cents in due:
            if at // 86_400_000_000 != day:
                day, spent = at // 86_400_000_000, 0
            out.append((key, run, _time(at), spent, spent < self.most))
            spent += cents
        over = (day + 1) * 86_400_000
        if day >= 0 and over < until:  # the day is over for good
            self.day.clear()
        elif due:
            self.day.update((day, spent))
            self.handle.registerTimer(over + 1)
        return out


def _stateful(runs: DataFrame, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    return rows(runs).withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def sessions_stream(runs: DataFrame, gap: timedelta = timedelta(hours=1), late: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream of runs, given out when the watermark has passed their end and the gap."""
    return _stateful(runs, _Sessions(gap), SESSIONS, late)


def spend_stream(runs: DataFrame, most: int, late: str = "1 hour") -> DataFrame:
    """Every run with what its session had spent that day before it, in cents, and whether that was below `most`."""
    return _stateful(runs, _Spend(most), VERDICTS, late)


def sessions(runs: DataFrame, gap: timedelta = timedelta(hours=1)) -> DataFrame:
    """The same sessions of a table."""
    w = Window.partitionBy("session_id").orderBy("ts", "run_id", "scope", "cents")
    micros = F.unix_micros("ts")
    pause = micros - F.lag(micros).over(w)
    new = F.coalesce((pause > int(gap.total_seconds() * 1_000_000)) | (F.col("scope") != F.lag("scope").over(w)), F.lit(True))
    turn = F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    each = rows(runs).withColumn("new", new).withColumn("turn", turn)
    return each.groupBy("session_id", "turn").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("scope").alias("scope"), F.count(F.lit(1)).alias("runs"), F.sum("cents").alias("cents")).drop("turn")


def spend(runs: DataFrame, most: int) -> DataFrame:
    """The same verdicts of a table."""
    w = Window.partitionBy("session_id", F.to_date("ts")).orderBy("ts", "run_id", "scope", "cents").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cents").over(w), F.lit(0))
    return rows(runs).select("session_id", "run_id", "ts", spent.alias("spent"), (spent < most).alias("allowed"))
