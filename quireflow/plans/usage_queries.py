"""Usage analytics and retention over the events and failed documents."""

from pyspark.sql import functions as F

from quireflow.operators import usage as ops
from quireflow.plans.registry import query
from quireflow.sources import corpus

SINCE = "2024-01-08 00:00:00"
NOW = 1704067200 + 30 * 86400


def _ts(column="ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("usage_by_user", "G1", f"""
SELECT "user", count(*) AS conversions, CAST(coalesce(sum(files), 0) AS BIGINT) AS files,
       CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(questions), 0) AS BIGINT) AS questions
FROM usage WHERE ts >= TIMESTAMP '{SINCE}' AND event IN ('convert', 'merge') GROUP BY "user" """, ("usage",))
def _(spark, folder):
    return ops.usage_by_user(corpus.usage(spark, folder), SINCE)


@query("usage_last_seen", "G2", f"""
SELECT s."user", coalesce(conversions, 0) AS conversions, coalesce(files, 0) AS files, coalesce(pages, 0) AS pages,
       coalesce(questions, 0) AS questions, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen
FROM (SELECT "user", max(ts) AS last_seen FROM usage WHERE ts >= TIMESTAMP '{SINCE}' GROUP BY "user") s
LEFT JOIN (SELECT "user", count(*) AS conversions, CAST(sum(files) AS BIGINT) AS files,
                  CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(questions) AS BIGINT) AS questions
           FROM usage WHERE ts >= TIMESTAMP '{SINCE}' AND event IN ('convert', 'merge') GROUP BY "user") c
ON s."user" = c."user" """, ("usage",))
def _(spark, folder):
    out = ops.with_last_seen(corpus.usage(spark, folder), SINCE)
    return out.withColumn("last_seen", _ts("last_seen"))


@query("usage_by_day", "G3", f"""
SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS conversions FROM usage
WHERE ts >= TIMESTAMP '{SINCE}' AND event IN ('convert', 'merge') GROUP BY 1""", ("usage",))
def _(spark, folder):
    return ops.usage_by_day(corpus.usage(spark, folder), SINCE).withColumn("date", F.col("date").cast("string"))


@query("usage_error_counts", "G4", f"""
SELECT count(*) FILTER (event = 'error' OR status = 'FAIL') AS errors, count(*) FILTER (event = 'download') AS downloads
FROM usage WHERE ts >= TIMESTAMP '{SINCE}'""", ("usage",))
def _(spark, folder):
    return ops.usage_counts(corpus.usage(spark, folder), SINCE)


@query("usage_totals", "G5", f"""
SELECT coalesce("user", '*') AS "user", count(*) AS conversions, CAST(sum(files) AS BIGINT) AS files,
       CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(questions) AS BIGINT) AS questions
FROM usage WHERE ts >= TIMESTAMP '{SINCE}' AND event IN ('convert', 'merge') GROUP BY ROLLUP ("user")""", ("usage",))
def _(spark, folder):
    return ops.usage_totals(corpus.usage(spark, folder), SINCE)


@query("usage_calendar_days", "G6", """
SELECT strftime(d, '%Y-%m-%d') AS date, count(u.id) AS conversions
FROM (SELECT unnest(generate_series(DATE '2023-12-12', DATE '2024-02-09', INTERVAL 1 DAY)) AS d)
LEFT JOIN (SELECT id, CAST(ts AS DATE) AS day FROM usage WHERE event IN ('convert', 'merge')) u ON u.day = d
GROUP BY d""", ("usage",))
def _(spark, folder):
    out = ops.usage_calendar(corpus.usage(spark, folder), "2024-02-09", 60)
    return out.withColumn("date", F.col("date").cast("string"))


@query("usage_calendar_months", "G6", """
SELECT strftime(d, '%Y-%m-%d') AS date, count(u.id) AS conversions
FROM (SELECT unnest(generate_series(DATE '2023-03-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS d)
LEFT JOIN (SELECT id, date_trunc('month', ts) AS day FROM usage WHERE event IN ('convert', 'merge')) u ON u.day = d
GROUP BY d""", ("usage",))
def _(spark, folder):
    out = ops.usage_calendar(corpus.usage(spark, folder), "2024-02-09", 365)
    return out.withColumn("date", F.col("date").cast("string"))


@query("usage_recent", "G7", """
SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event, "user", pages, status,
       CASE event WHEN 'join' THEN '초대 링크 접속' WHEN 'upload' THEN 'PDF 올리기' WHEN 'convert' THEN '변환'
            WHEN 'download' THEN '내려받기' WHEN 'error' THEN '오류' ELSE event END AS label
FROM usage ORDER BY usage.ts DESC, id DESC""", ("usage",))
def _(spark, folder):
    out = ops.recent(corpus.usage(spark, folder), None)
    return out.select("id", _ts(), "event", "user", "pages", "status", "label")


@query("usage_pruned", "G8", """
SELECT event, count(*) AS kept, min(id) AS first_id FROM usage WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY
GROUP BY event""", ("usage",))
def _(spark, folder):
    kept = ops.prune_usage(corpus.usage(spark, folder), "2024-01-31 00:00:00", 20)
    return kept.groupBy("event").agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))


@query("usage_stored_rows", "A12", """
SELECT id, coalesce(nullif(trim("user"), ''), '?') AS "user", event, round_even(seconds * 100, 0) / 100 AS seconds,
       strftime(ts, '%Y-%m-%d') AS date, json_extract_string(props, '$.k') AS k FROM usage""", ("usage",))
def _(spark, folder):
    rows = ops.append_rows(corpus.usage(spark, folder))
    return rows.select("id", "user", "event", "seconds", F.col("date").cast("string"),
                       F.get_json_object("detail", "$.k").alias("k"))


@query("failed_sample_keys", "G9", """
SELECT doc_id // 8 AS sample, 'merge' AS kind,
       substr(sha256('merge:' || string_agg(sha256(text), ',' ORDER BY doc_id)), 1, 20) AS key
FROM documents GROUP BY doc_id // 8""")
def _(spark, folder):
    docs = corpus.table(spark, folder, "documents")
    return ops.sample_keys(docs.select(F.floor(F.col("doc_id") / 8).alias("sample"), F.lit("merge").alias("kind"),
                                       F.col("doc_id").alias("ord"), F.col("text").alias("content")))


UPSERTED = """
SELECT key, kind, count(*) AS count, min(ts) AS first_ts, max(ts) AS ts, max(doc_id) AS doc_id,
       arg_max("user", doc_id) AS "user", arg_max(status, doc_id) AS status, arg_max(has_result, doc_id) AS has_result,
       arg_max(size, doc_id) AS size, arg_max(cause, doc_id) AS cause, right(arg_max(error, doc_id), 4000) AS error
FROM failures GROUP BY key, kind"""


@query("failed_samples_upsert", "G10", UPSERTED, ("failures",))
def _(spark, folder):
    return ops.upsert_samples(corpus.failures(spark, folder))


@query("failed_samples_list", "G11", f"""
SELECT key, count, size, has_result, ts + 1209600 AS expires_at, '변환' AS kind_label FROM ({UPSERTED})""", ("failures",))
def _(spark, folder):
    out = ops.list_samples(ops.upsert_samples(corpus.failures(spark, folder)))
    return out.select("key", "count", "size", "has_result", "expires_at", "kind_label")


KEPT = f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, key DESC) AS rank,
       sum(size) OVER (ORDER BY ts DESC, key DESC ROWS UNBOUNDED PRECEDING) AS total
FROM ({UPSERTED}) WHERE 1704130000 - ts <= 14 * 86400) WHERE rank <= 200 AND total <= 200000"""


@query("failed_samples_retention", "G12", f"SELECT key, ts, size FROM ({KEPT})", ("failures",))
def _(spark, folder):
    store = ops.upsert_samples(corpus.failures(spark, folder))
    return ops.prune_samples(store, 1704130000, 14, 200, 200000).select("key", "ts", "size")


@query("failed_samples_display", "G13", f"""
SELECT key, regexp_extract(trim(error), '[^\\n]*$') AS last_error,
       CAST(greatest(0, ceil((ts + 1209600 - 1704130000) / 86400.0)) AS INTEGER) AS days_left
FROM ({UPSERTED}) WHERE status IN ('FAIL', 'ERROR')""", ("failures",))
def _(spark, folder):
    store = ops.list_samples(ops.failed_only(ops.upsert_samples(corpus.failures(spark, folder))))
    return ops.display_rows(store, 1704130000).select("key", "last_error", "days_left")


@query("usage_people", "G14", """SELECT DISTINCT "user" FROM usage""", ("usage",))
def _(spark, folder):
    return ops.people(corpus.usage(spark, folder))


@query("live_jobs", "G15", """
SELECT count(*) AS live FROM usage WHERE epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) < 86400 AND event <> 'join'""", ("usage",))
def _(spark, folder):
    jobs = corpus.usage(spark, folder).select(F.col("ts").cast("long").alias("created"), (F.col("event") == "join").alias("bundle"))
    return ops.live_jobs(jobs, 1705708800, 86400)


STAMPED = r"""
SELECT doc_id, strftime(make_timestamp(ts * 1000000), '%Y%m%d-%H%M%S') || '-' ||
       CASE WHEN size % 3 = 0 THEN substr(key, 1, 5) || 'Z' ELSE substr(key, 1, 6) END AS id, status FROM failures"""


@query("failed_samples_deleted", "G16", f"""
SELECT doc_id, id FROM ({STAMPED}) s WHERE NOT (status = 'ERROR' AND regexp_full_match(id, '\\d{{8}}-\\d{{6}}-[0-9a-f]{{6}}'))""", ("failures",))
def _(spark, folder):
    rows = corpus.failures(spark, folder)
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyyMMdd-HHmmss")
    tail = F.when(F.col("size") % 3 == 0, F.concat(F.substring("key", 1, 5), F.lit("Z"))).otherwise(F.substring("key", 1, 6))
    store = rows.select("doc_id", F.concat_ws("-", stamp, tail).alias("id"), "status")
    return ops.delete_samples(store, store.where("status = 'ERROR'")).select("doc_id", "id")
