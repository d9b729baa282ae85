"""Job lifecycle with time to live: state per job, driven by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOB_TTL = 30 * 60
DOWNLOAD_TTL = 10 * 60
EVENTS = ("upload", "convert", "download", "delete")
OUT = "job string, ts timestamp, outcome string"
# all times in microseconds; the arrays are the events the watermark has not passed yet
STATE = "expires bigint, until bigint, at array<bigint>, ids array<bigint>, names array<string>"
SECOND = 1_000_000


def _step(expires: int | None, until: int | None, now: int, name: str) -> tuple[int | None, int | None, str]:
    """A job's times, and the outcome, after one event; the job has not expired before it."""
    if name == "upload":
        return now + JOB_TTL * SECOND, 0, "opened"
    if expires is None:
        return None, None, "missing"
    if name == "convert":
        return expires, min(now + DOWNLOAD_TTL * SECOND, expires), "converted"
    if name == "delete":
        return None, None, "deleted"
    return expires, until, "downloaded" if now <= until else "gone"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job: upload opens it, convert opens the download window, delete closes it, time expires it.

    Events wait in the state until the watermark has passed them, so they take effect in the order they happened in, in
    whatever order and trigger they came.
    """
    expires, until, *waiting = state.getOption or (None, None, [], [], [])
    events = list(zip(*waiting, strict=True))
    if not state.hasTimedOut:
        for batch in batches:
            known = batch[batch["event"].isin(EVENTS)]
            events += zip(known["ts"].astype("datetime64[us]").astype("int64").tolist(), known["id"].tolist(), known["event"].tolist(), strict=True)
    passed = state.getCurrentWatermarkMs() * 1000
    out = []
    for now, _, name in sorted(e for e in events if e[0] <= passed):
        if expires is not None and now > expires:
            out.append((expires, "expired"))
            expires = until = None
        expires, until, outcome = _step(expires, until, now, name)
        out.append((now, outcome))
    if expires is not None and expires < passed:
        out.append((expires, "expired"))
        expires = until = None
    events = sorted(e for e in events if e[0] > passed)
    if expires is None and not events:
        if state.exists:
            state.remove()
    else:
        state.update((expires, until, *([e[k] for e in events] for k in range(3))))
        wake = min([*(e[0] for e in events[:1]), *([expires] if expires is not None else [])])
        state.setTimeoutTimestamp(max(wake // 1000 + 1, passed // 1000 + 1))
    yield pd.DataFrame({"job": [key[0]] * len(out), "ts": pd.to_datetime([ts for ts, _ in out], unit="us"), "outcome": [o for _, o in out]})


def job_lifecycle(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Outcome of every job event of a stream, and of every expiry. `events` has job, id, ts, event.

    Events later than the watermark are dropped. An outcome comes once the watermark has passed its event; until then the
    state holds it, so a job's state is two numbers and its events of the last `lateness`, and leaves with the job.
    """
    return events.withWatermark("ts", lateness).groupBy("job").applyInPandasWithState(
        _advance, outputStructType=OUT, stateStructType=STATE, outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)


def expired_batch(events: DataFrame) -> DataFrame:
    """The expiries over a finished log: uploads after which neither another upload nor a delete comes in time."""
    from quireflow.functions import scan

    ends = events.where(F.col("event").isin("upload", "delete")).withColumn("hour", F.floor(F.unix_micros("ts") / (3600 * SECOND)))
    ends = scan.neighbours(ends, ["job"], ["hour"], ["ts", "id"], lead={"then": F.col("ts")})
    limit = F.col("ts") + F.expr(f"interval {JOB_TTL} seconds")
    return ends.where((F.col("event") == "upload") & (F.col("then").isNull() | (F.col("then") > limit))).select("job", limit.alias("ts"))


def lifecycle_batch(events: DataFrame) -> DataFrame:
    """The same outcomes over a finished log, by running maxima in chunks of an hour.

    A job is open if its last upload is younger than the time to live and no delete lies between; the download window is
    that of the last conversion since then.
    """
    from quireflow.functions import scan
    seconds = F.unix_micros("ts") / 1_000_000.0

    def at(name: str) -> Column:
        return F.when(F.col("event") == name, F.col("now"))

    rows = events.withColumns({"now": seconds, "hour": F.floor(seconds / 3600)})
    rows = scan.running(rows, ["job"], ["hour"], ["ts", "id"], lasts={"up": at("upload"), "gone": at("delete"), "conv": at("convert")})
    # a delete at this row still finds the job open, so it only counts for later rows
    rows = scan.neighbours(rows, ["job"], ["hour"], ["ts", "id"], lag={"p_gone": F.col("gone")})
    open_ = F.col("up").isNotNull() & (F.col("now") <= F.col("up") + JOB_TTL) & (F.coalesce("p_gone", F.lit(-1.0)) < F.col("up"))
    window = F.least(F.col("conv") + DOWNLOAD_TTL, F.col("up") + JOB_TTL)
    fresh = F.coalesce(F.col("conv") > F.col("up"), F.lit(False))
    outcome = (F.when(F.col("event") == "upload", "opened").when(~open_, "missing").when(F.col("event") == "convert", "converted")
               .when(F.col("event") == "delete", "deleted").when(F.col("event") == "download", F.when(fresh & (F.col("now") <= window), "downloaded").otherwise("gone")))
    return rows.withColumn("outcome", F.coalesce(outcome, F.lit("missing"))).where(F.col("event").isin("upload", "convert", "download", "delete")).select("job", "id", "ts", "outcome")


def bundle_ready(members: DataFrame, now: int) -> DataFrame:
    """Bundles whose members are all converted and inside their windows; a bundle's window is the shortest of them."""
    inside = F.col("converted") & (F.lit(now) <= F.col("until"))
    return members.groupBy("bundle").agg(F.bool_and(inside).alias("ready"), F.min("until").alias("until"), F.count("*").alias("members"))
