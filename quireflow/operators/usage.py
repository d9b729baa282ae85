"""Usage analytics and the bounded store of failed conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONVERSIONS = ("convert", "merge")
# Labels of the usage events.
EVENT_LABELS = {
    "join": "초대 링크 접속", "upload": "PDF 올리기", "convert": "변환", "merge": "통합본 만들기", "zip": "ZIP 묶기",
    "download": "내려받기", "error": "오류",
}
KIND_LABELS = {"convert": "변환", "merge": "통합본", "upload": "올리기"}
SAMPLE_ID = r"^\d{8}-\d{6}-[0-9a-f]{6}$"


def _mapped(column: str, mapping: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(table[F.col(column)], F.col(column))


def _window(usage: DataFrame, since: str | None, user: str | None) -> DataFrame:
    if since is not None:
        usage = usage.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return usage.where(F.col("user") == user) if user else usage


def usage_by_user(usage: DataFrame, since: str | None = None, user: str | None = None) -> DataFrame:
    """Conversions and summed files, pages and questions of each user since a time, most active first."""
    rows = _window(usage, since, user).where(F.col("event").isin(*CONVERSIONS))
    zero = F.lit(0)
    return rows.groupBy("user").agg(
        F.count("*").alias("conversions"),
        *[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in ("files", "pages", "questions")],
    ).orderBy(F.desc("conversions"), "user")


def with_last_seen(usage: DataFrame, since: str | None = None, user: str | None = None) -> DataFrame:
    """usage_by_user plus the last event of any kind; users without conversions appear with zeros.

    One aggregation over all events gives both, so no join of two aggregates is needed.
    """
    done = F.col("event").isin(*CONVERSIONS)
    rows = _window(usage, since, user)
    return rows.groupBy("user").agg(
        F.count_if(done).alias("conversions"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c)
          for c in ("files", "pages", "questions")],
        F.max("ts").alias("last_seen"),
    )


def usage_by_day(usage: DataFrame, since: str | None = None, user: str | None = None) -> DataFrame:
    """Conversions per date in the session time zone."""
    rows = _window(usage, since, user).where(F.col("event").isin(*CONVERSIONS))
    return rows.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("conversions")).orderBy("date")


def usage_counts(usage: DataFrame, since: str | None = None, user: str | None = None) -> DataFrame:
    """Errors (an error event or a failed status) and downloads."""
    return _window(usage, since, user).agg(
        F.count_if((F.col("event") == "error") | (F.col("status") == "FAIL")).alias("errors"),
        F.count_if(F.col("event") == "download").alias("downloads"))


def usage_totals(usage: DataFrame, since: str | None = None) -> DataFrame:
    """Per-user rows and their total (user null) in one ROLLUP."""
    rows = _window(usage, since, None).where(F.col("event").isin(*CONVERSIONS))
    return rows.rollup("user").agg(
        F.count("*").alias("conversions"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("files", "pages", "questions")],
    ).select(F.coalesce("user", F.lit("*")).alias("user"), "conversions", "files", "pages", "questions")


def usage_calendar(usage: DataFrame, until: str, days: int) -> DataFrame:
    """Conversions per day with zero rows for quiet days (up to 90 days), else per month for twelve months.

    The calendar has at most 90 rows, a bound the call itself sets, so it is the broadcast side.
    """
    spark = usage.sparkSession
    end = F.to_date(F.lit(until))
    if days <= 90:
        dates = F.sequence(F.date_sub(end, days - 1), end)
        bucket = F.to_date("ts")
    else:
        last = F.trunc(end, "month")
        dates = F.sequence(F.add_months(last, -11), last, F.expr("interval 1 month"))
        bucket = F.trunc(F.to_date("ts"), "month")
    calendar = spark.range(1).select(F.explode(dates).alias("date"))
    done = usage.where(F.col("event").isin(*CONVERSIONS)).groupBy(bucket.alias("date")).agg(F.count("*").alias("n"))
    return calendar.join(done, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).cast("long").alias("conversions")).orderBy("date")


def recent(usage: DataFrame, limit: int | None = 200, user: str | None = None) -> DataFrame:
    """Newest rows first, with a label for each event: `limit` of them, at least one, or all for None."""
    rows = _window(usage, None, user).orderBy(F.desc("ts"), F.desc("id"))
    return (rows if limit is None else rows.limit(max(1, int(limit)))).withColumn("label", _mapped("event", EVENT_LABELS))


def prune_usage(usage: DataFrame, now: str, keep_days: float = 365) -> DataFrame:
    """Rows not older than keep_days. Written back with dynamic partition overwrite by date."""
    return usage.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(keep_days * 86400)} seconds"))


def append_rows(batch: DataFrame) -> DataFrame:
    """Rows as they are stored: blank user '?', seconds to two places, detail as JSON text."""
    cents = F.rint(F.col("seconds") * 100) / 100
    return batch.withColumns({
        "user": F.when(F.coalesce(F.trim("user"), F.lit("")) == "", "?").otherwise(F.col("user")),
        "seconds": cents,
        "detail": F.coalesce(F.to_json("detail"), F.lit("")),
        "date": F.to_date("ts"),
    })


def append_usage(batch: DataFrame, path: str) -> None:
    """Appends a batch to the log, partitioned by date so that later reads and pruning skip files."""
    append_rows(batch).write.mode("append").partitionBy("date").parquet(path)


def sample_keys(members: DataFrame) -> DataFrame:
    """Key of a failed conversion: twenty hex digits over its kind and the hashes of its sources in order.

    `members` has sample, kind, ord, content. A sample has at most ten members (the admission limit), so the ordered list
    is short. Only the 64-character hashes are shuffled, never the content.
    """
    hashed = members.select("sample", "kind", "ord", F.sha2("content", 256).alias("hash"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "hash")))
    joined = F.array_join(F.transform(rows, lambda r: r["hash"]), ",")
    return hashed.groupBy("sample", "kind").agg(joined.alias("hashes")).select(
        "sample", "kind",
        F.substring(F.sha2(F.concat("kind", F.lit(":"), "hashes"), 256), 1, 20).alias("key"))


def failed_only(jobs: DataFrame) -> DataFrame:
    """Only failed and broken conversions are kept."""
    return jobs.where(F.col("status").isin("FAIL", "ERROR"))


def upsert_samples(rows: DataFrame) -> DataFrame:
    """Folds repeated failures of the same key: count adds up, the first time stays, the newest row's fields win.

    `rows` is the union of the store and the new failures. All aggregates combine before the shuffle, so a key that holds
    very many repeats costs its reducer one row per map task. The error text is cut before it is shuffled.
    """
    newest = F.struct("ts", "doc_id")
    fields = ["user", "status", "has_result", "size", "cause"]
    latest = F.max_by(F.struct(*fields, F.expr("right(error, 4000)").alias("error")), newest)
    out = rows.groupBy("key", "kind").agg(
        F.sum(F.coalesce("count", F.lit(1)) if "count" in rows.columns else F.lit(1)).cast("long").alias("count"),
        F.min(F.coalesce("first_ts", "ts") if "first_ts" in rows.columns else F.col("ts")).alias("first_ts"),
        F.max("ts").alias("ts"), F.max("doc_id").alias("doc_id"), latest.alias("latest"))
    return out.select("key", "kind", "count", "first_ts", "ts", "doc_id", "latest.*")


def list_samples(store: DataFrame, keep_days: int = 14) -> DataFrame:
    """The store as shown: expiry, label and size, newest first."""
    return store.withColumns({
        "expires_at": F.col("ts") + keep_days * 86400,
        "kind_label": _mapped("kind", KIND_LABELS),
    }).orderBy(F.desc("ts"), "key")


def display_rows(store: DataFrame, now: int) -> DataFrame:
    """Last line of the error and days left, rounded up."""
    lines = F.split(F.trim("error"), "\n")
    return store.withColumns({
        "last_error": F.element_at(lines, -1),
        "days_left": F.greatest(F.lit(0), F.ceil((F.col("expires_at") - F.lit(now)) / 86400.0)).cast("int"),
    })


def prune_samples(store: DataFrame, now: int, keep_days: int = 14, max_count: int = 30, max_bytes: int = 10**9) -> DataFrame:
    """Keeps the longest newest prefix that is young enough, at most max_count long and at most max_bytes big.

    Dropping the oldest until both limits hold keeps exactly the newest prefix on which both running totals hold. The
    store is bounded by max_count only afterwards, so the totals are first taken per day; full rows are ordered only
    inside the days that can still be kept. Both steps shuffle day rows, not the store.
    """
    young = store.where(F.lit(now) - F.col("ts") <= keep_days * 86400)
    day = F.floor(F.col("ts") / 86400).alias("day")
    per_day = young.groupBy(day).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # one row per day of the keep period, and of days after now if clocks differ
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    before = per_day.select("day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("n_before"),
                            F.coalesce(F.sum("bytes").over(later), F.lit(0)).alias("bytes_before"))
    open_days = before.where((F.col("n_before") < max_count) & (F.col("bytes_before") <= max_bytes))
    rows = young.withColumn("day", day).join(open_days, "day")
    newest = Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("key"))
    running = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= max_count)
    kept = ranked.withColumn("total", F.sum("size").over(running)).where(
        (F.col("rank") + F.col("n_before") <= max_count) & (F.col("total") + F.col("bytes_before") <= max_bytes))
    return kept.select(*store.columns)


def delete_samples(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the given ids; ids of another shape are ignored."""
    return store.join(ids.where(F.col("id").rlike(SAMPLE_ID)).select("id").distinct(), "id", "left_anti")


def people(usage: DataFrame) -> DataFrame:
    """Known names, sorted."""
    return usage.select("user").distinct().orderBy("user")


def live_jobs(jobs: DataFrame, now: int, ttl: int = 1800) -> DataFrame:
    """Jobs opened within the time to live that are no bundles."""
    return jobs.where((F.lit(now) - F.col("created") < ttl) & ~F.col("bundle")).agg(F.count("*").alias("live"))
