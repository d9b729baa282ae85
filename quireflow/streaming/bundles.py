"""When bundles of jobs are ready to be fetched: every member converted and inside its download window.

Events have bundle, job, id, ts, event and until. `member` adds a job to a bundle, `convert` opens its window up to and
with `until` (a later one replaces it), `delete` takes the conversion back, `close` ends the bundle: what comes later under
its name is a new one. Other events count for nothing. Events of one instant take effect in the order of their ids and are
judged together. A bundle is ready while it has members and the window of each is open, so its own window ends with the
shortest. Both forms return flips: bundle, ts, ready, members, one row for each instant from which on it is, or is not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quireflow.functions import scan

FLIPS = "bundle string, ts timestamp, ready boolean, members bigint"
HOUR = 3600 * 1_000_000
EVENTS = ("member", "convert", "delete", "close")


def _timed(events: DataFrame) -> DataFrame:
    """Events in microseconds, with the number of the bundle of that name they belong to."""
    rows = events.where(F.col("event").isin(*EVENTS)).select(
        "bundle", "job", "id", "event", F.unix_micros("ts").alias("at"), F.unix_micros("until").alias("until"))
    rows = rows.withColumn("hour", F.expr(f"`at` div {HOUR}"))
    closes = (F.col("event") == "close").cast("long")
    return scan.running(rows, ["bundle"], ["hour"], ["at", "id"], sums={"closed_before": closes}).withColumn("turn", F.col("closed_before") - closes).drop("closed_before")


def _conversions(rows: DataFrame) -> DataFrame:
    """The last conversion or deletion of each job and instant, and when the next comes."""
    last = rows.where(F.col("event").isin("convert", "delete")).groupBy("bundle", "turn", "job", "hour", "at").agg(
        F.max_by(F.struct("event", "until"), "id").alias("e"))
    last = last.select("bundle", "turn", "job", "hour", "at", F.when(F.col("e.event") == "convert", F.col("e.until")).alias("until"))
    return scan.neighbours(last, ["bundle", "turn", "job"], ["hour"], ["at"], lead={"then": F.col("at")})


def bundle_flips(events: DataFrame) -> DataFrame:
    """Flips of every bundle over a finished log, by a sweep over the ends of membership and of open windows.

    Steps are summed per bundle and instant before they are ordered, and ordered in chunks of an hour, so one bundle with
    very many events is spread.
    """
    rows = _timed(events)
    turn = ["bundle", "turn"]
    closed = rows.where("event = 'close'").select(*turn, F.col("at").alias("closed"))
    joined = rows.where("event = 'member'").groupBy(*turn, "job").agg(F.min("at").alias("joined")).join(closed, turn, "left")
    inside = _conversions(rows).where("until is not null").join(joined, [*turn, "job"]).select(
        "bundle", F.greatest("at", "joined").alias("start"), F.least(F.col("until") + 1, "then", "closed").alias("end")).where("start < end")

    def steps(spans: DataFrame, members: int, open_: int) -> DataFrame:
        ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("sign")))
        return spans.select("bundle", F.explode(ends).alias("s")).where("s.at is not null").select(
            "bundle", "s.at", (F.col("s.sign") * members).alias("members"), (F.col("s.sign") * open_).alias("open"))

    both = steps(joined.select("bundle", F.col("joined").alias("start"), F.col("closed").alias("end")), 1, 0).unionByName(steps(inside, 0, 1))
    summed = both.groupBy("bundle", "at").agg(F.sum("members").alias("m"), F.sum("open").alias("o")).withColumn("hour", F.expr(f"`at` div {HOUR}"))
    known = scan.running(summed, ["bundle"], ["hour"], ["at"], sums={"members": F.col("m"), "open": F.col("o")})
    known = known.withColumn("ready", (F.col("members") > 0) & (F.col("open") == F.col("members")))
    known = scan.neighbours(known, ["bundle"], ["hour"], ["at"], lag={"was": F.col("ready")})
    return known.where(F.col("ready") != F.coalesce("was", F.lit(False))).select(
        "bundle", F.timestamp_micros("at").alias("ts"), "ready", F.col("members").cast("long").alias("members"))


def bundle_snapshot(events: DataFrame, asof: str) -> DataFrame:
    """What a stream that starts after the instant `asof` must know: bundle, job, joined, until, asof (microseconds).

    One row for each job of each bundle that is not closed; `until` is null for jobs not converted.
    """
    limit = F.lit(asof).cast("timestamp")
    rows = _timed(events.where(F.col("ts") <= limit))
    current = rows.groupBy("bundle").agg(F.sum((F.col("event") == "close").cast("long")).alias("turn"))
    open_ = rows.join(current, ["bundle", "turn"])
    last = F.max_by(F.when(F.col("event") == "convert", F.col("until")), F.when(F.col("event").isin("convert", "delete"), F.struct("at", "id")))
    return open_.groupBy("bundle", "job").agg(F.bool_or(F.col("event") == "member").alias("joined"), last.alias("until")).withColumn("asof", F.unix_micros(limit))


class _Bundle(StatefulProcessor):
    """One bundle. Events wait until the watermark has passed them; a timer stands at the first and at the window's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job string", "joined boolean, until bigint")
        self.waiting = handle.getMapState("waiting", "at bigint, id bigint, job string", "event string, until bigint")
        self.ready = handle.getValueState("ready", "ready boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            known = batch[batch["event"].isin(EVENTS)]
            for at, name, job, event, until in zip(known["at"], known["id"], known["job"], known["event"], known["until_at"], strict=True):
                self.waiting.updateValue((int(at), int(name), job), (event, None if pd.isna(until) else int(until)))
        yield self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        jobs = {}
        for job, joined, until in zip(initialState["job"], initialState["joined"], initialState["until"], strict=True):
            jobs[job] = (bool(joined), None if pd.isna(until) else int(until))
            self.jobs.updateValue((job,), jobs[job])
        ready = self._open(jobs, int(initialState["asof"].iloc[0]))
        self.ready.update((ready,))
        if ready:
            self.handle.registerTimer(self._end(jobs) // 1000 + 1)

    @staticmethod
    def _open(jobs: dict, now: int) -> bool:
        members = [until for joined, until in jobs.values() if joined]
        return bool(members) and all(until is not None and until >= now for until in members)

    @staticmethod
    def _end(jobs: dict) -> int:
        """First instant behind the bundle's window."""
        return min(until for joined, until in jobs.values() if joined) + 1

    def _advance(self, key, timerValues) -> pd.DataFrame:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((*where, *what) for where, what in self.waiting.iterator())
        jobs = {job[0]: tuple(state) for job, state in self.jobs.iterator()}
        before = dict(jobs)
        ready = bool(self.ready.exists() and self.ready.get()[0])
        out, done = [], 0
        while True:
            points = ([waiting[done][0]] if done < len(waiting) else []) + ([self._end(jobs)] if ready else [])
            now = min(points, default=passed + 1)
            if now > passed:
                break
            while done < len(waiting) and waiting[done][0] == now:
                _, _, job, event, until = waiting[done]
                if event == "close":
                    jobs = {}
                else:
                    joined, open_until = jobs.get(job, (False, None))
                    jobs[job] = (True, open_until) if event == "member" else (joined, until if event == "convert" else None)
                done += 1
            if self._open(jobs, now) != ready:
                ready = not ready
                out.append((key[0], now, ready, sum(joined for joined, _ in jobs.values())))
        for row in waiting[:done]:
            self.waiting.removeKey(tuple(row[:3]))
        for job in before.keys() - jobs.keys():
            self.jobs.removeKey((job,))
        for job, state in jobs.items():
            if before.get(job) != state:
                self.jobs.updateValue((job,), state)
        if jobs or ready:
            self.ready.update((ready,))
        else:
            self.ready.clear()
        for point in ([waiting[done][0]] if done < len(waiting) else []) + ([self._end(jobs)] if ready else []):
            self.handle.registerTimer(point // 1000 + 1)
        return pd.DataFrame({"bundle": pd.Series([r[0] for r in out], dtype=object), "ts": pd.to_datetime([r[1] for r in out], unit="us"),
                             "ready": [r[2] for r in out], "members": [r[3] for r in out]})

    def close(self) -> None:
        pass


def bundle_stream(streams: Sequence[DataFrame], lateness: str = "10 minutes", snapshot: DataFrame | None = None) -> DataFrame:
    """Flips of the bundles that several streams of job events speak of, once the watermark of all has passed them.

    Events later than the watermark are dropped. `snapshot` is a bundle_snapshot() of what came before; flips up to its
    instant are not told again. State leaves with the bundle's `close`.
    """
    rows = None
    for stream in streams:
        one = stream.select(F.col("bundle").cast("string").alias("bundle"), F.col("job").cast("string").alias("job"), F.col("id").cast("bigint").alias("id"), "ts", "event",
                            F.unix_micros("ts").alias("at"), F.unix_micros("until").alias("until_at")).withWatermark("ts", lateness)
        rows = one if rows is None else rows.unionByName(one)
    start = None if snapshot is None else snapshot.select(
        F.col("bundle").cast("string").alias("bundle"), F.col("job").cast("string").alias("job"), "joined", "until", "asof").groupBy("bundle")
    return rows.groupBy("bundle").transformWithStateInPandas(
        statefulProcessor=_Bundle(), outputStructType=FLIPS, outputMode="Append", timeMode="EventTime", initialState=start)


BUNDLE_STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
