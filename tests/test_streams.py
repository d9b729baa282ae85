"""Streaming forms against their finished-log twins."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quireflow.operators import convert
from quireflow.operators import usage as ops
from quireflow.sources import corpus
from quireflow.plans.export_queries import bundle_events
from quireflow.streaming import bundles, feeds, incremental, jobs


def _stage(df):
    path = tempfile.mkdtemp(prefix="spark-stream-")
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def test_usage_stream(spark, folder):
    usage = corpus.usage(spark, folder)
    path = _stage(usage)
    stream = feeds.usage_stream(spark.readStream.schema(usage.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("usage_daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("usage_daily").collect()}
    assert got == {tuple(r) for r in feeds.daily_usage(usage).collect()}


def test_job_lifecycle_stream(spark, folder):
    """Events shuffled over several triggers, late ones included, give the outcomes of the log in order."""
    usage = corpus.usage(spark, folder).where("event <> 'join'")
    events = usage.select(F.col("user").alias("job"), "id", "ts", F.when(F.col("event") == "error", "delete").otherwise(F.col("event")).alias("event"))
    path = tempfile.mkdtemp(prefix="spark-stream-")
    for part in range(3):
        events.where(F.abs(F.hash("id")) % 3 == part).orderBy(F.hash("job", "id")).coalesce(1).write.mode("append").parquet(path)
    # a last event, far ahead, moves the watermark past all others
    events.agg(F.max("ts").alias("ts")).select(F.lit("~").alias("job"), F.lit(-1).cast("bigint").alias("id"), F.expr("ts + interval 400 days").alias("ts"), F.lit("delete").alias("event")).select(
        *[F.col(c).cast(events.schema[c].dataType) for c in events.columns]).coalesce(1).write.mode("append").parquet(path)
    # the lateness covers the whole log, since its thirds overlap in full
    out = jobs.job_lifecycle(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path), "300 days")
    query = out.writeStream.format("memory").queryName("lifecycle").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.job, r.ts, r.outcome) for r in spark.table("lifecycle").where("job <> '~'").collect())
    expected = [(r.job, r.ts, r.outcome) for r in jobs.lifecycle_batch(events).collect()] + [(r.job, r.ts, "expired") for r in jobs.expired_batch(events).collect()]
    assert got == sorted(expected)
    assert {o for _, _, o in got} >= {"expired", "opened", "missing"}


def test_samples_stream(spark, folder):
    failures = corpus.failures(spark, folder)
    path = _stage(failures)
    store, checkpoint = tempfile.mkdtemp(prefix="spark-store-"), tempfile.mkdtemp(prefix="spark-ck-")
    query = feeds.samples_stream(spark.readStream.schema(failures.schema).parquet(path), store, checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, r["count"]) for r in spark.read.parquet(f"{store}/version=0").collect()}
    assert got == {(r.key, r["count"]) for r in ops.upsert_samples(failures).collect()}


def test_samples_stream_later_batches(spark, folder):
    """Three triggers give the store of all failures; a batch run again changes nothing; old versions go."""
    failures = corpus.failures(spark, folder)
    failures = failures.withColumn("key", F.concat(F.lit("k"), (F.col("doc_id") % 4).cast("string")))
    path = tempfile.mkdtemp(prefix="spark-stream-")
    for part in range(3):
        failures.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    store, checkpoint = tempfile.mkdtemp(prefix="spark-store-"), tempfile.mkdtemp(prefix="spark-ck-")
    stream = spark.readStream.schema(failures.schema).option("maxFilesPerTrigger", 1).parquet(path)
    feeds.samples_stream(stream, store, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(os.listdir(store)) == ["version=1", "version=2"]

    def rows(df):
        return sorted(tuple(str(r[c]) for c in ("key", "count", "first_ts", "ts", "doc_id", "status", "error")) for r in df.collect())

    expected = rows(ops.upsert_samples(failures))
    assert rows(spark.read.parquet(f"{store}/version=2")) == expected
    # the driver is lost after the last batch was written, before it was noted as done
    for name in os.listdir(f"{checkpoint}/commits"):
        if name in ("2", ".2.crc"):
            os.remove(f"{checkpoint}/commits/{name}")
    feeds.samples_stream(stream, store, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{store}/version=2")) == expected


def _word_stages(version="1", fails=False):
    def count(docs, lines):
        if fails:
            raise RuntimeError("lost")
        return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.lit(version).alias("made_by"))

    return [incremental.Stage("lines", "1", lambda docs: docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))),
            incremental.Stage("counts", version, count, ("lines",)),
            incremental.Stage("total", "1", lambda docs, counts: counts.select("doc_id", (F.col("lines") + F.col("chars")).alias("total")), ("counts",))]


def test_document_store(spark):
    folder = tempfile.mkdtemp(prefix="spark-store-")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    totals = lambda store: {r.doc_id: r.total for r in store.rows("total").collect()}
    ran = lambda stage, batch: sorted({r.doc_id for r in spark.read.parquet(f"{folder}/{stage}/batch={batch}").collect()})
    store = incremental.DocumentStore(spark, folder, _word_stages())
    with pytest.raises(LookupError):
        store.rows("total")
    first = docs((1, "a\nb"), (2, "cc"), (2, "cc"), (3, None), (4, "dddd"), (None, "x"))
    assert store.update(first, 0) == {"lines": 4, "counts": 4, "total": 4}
    assert totals(store) == {1: 4, 2: 3, 3: 1, 4: 5}
    second = docs((2, "cc"), (4, "changed"), (5, "new\nnew"))
    # lost before its manifest: nothing of the batch is seen, and running it again gives all of it
    with pytest.raises(RuntimeError):
        incremental.DocumentStore(spark, folder, _word_stages(fails=True)).update(second, 1)
    assert totals(store) == {1: 4, 2: 3, 3: 1, 4: 5}
    assert store.update(second, 1) == {"lines": 2, "counts": 2, "total": 2} and ran("lines", 1) == ran("total", 1) == [4, 5]
    expected = {1: 4, 2: 3, 3: 1, 4: 8, 5: 8}
    assert totals(store) == expected
    assert store.update(docs((1, "other")), 1) == {"lines": 0, "counts": 0, "total": 0} and totals(store) == expected
    assert store.update(second, 2) == {"lines": 0, "counts": 0, "total": 0} and totals(store) == expected
    # a new version of a stage: it and what uses it run again, from stored rows and, for a changed document, new ones
    later = incremental.DocumentStore(spark, folder, _word_stages("2"))
    assert later.update(docs((1, "a\nb"), (2, "now longer"), (5, "new\nnew")), 3) == {"lines": 1, "counts": 3, "total": 3}
    assert totals(later) == expected | {2: 11} and ran("lines", 3) == [2] and ran("counts", 3) == [1, 2, 5]
    assert {r.doc_id: r.made_by for r in later.rows("counts").collect()} == {1: "2", 2: "2", 3: "1", 4: "1", 5: "2"}
    # rows of the first two batches are still in use; once all documents are new, they are not
    assert later.vacuum() == []
    everything = docs((1, "a\nb"), (2, "now longer"), (3, ""), (4, "changed"), (5, "new\nnew"))
    assert later.update(everything, 4) == {"lines": 0, "counts": 2, "total": 2}
    assert later.vacuum() == ["counts/batch=0", "counts/batch=1", "total/batch=0", "total/batch=1"]
    assert totals(later) == expected | {2: 11}
    assert later.update(docs(), 5) == {"lines": 0, "counts": 0, "total": 0}


def test_document_stream(spark, folder):
    """Two triggers with new, changed and unchanged documents through the conversion give what the batch gives."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 14 AND length(text) < 6000").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("text", F.concat(F.lit("1. first\n"), "text", F.lit("\n2. second")))
    ids = sorted(r.doc_id for r in docs.collect())
    changed = docs.withColumn("text", F.when(F.col("doc_id") == ids[1], F.concat("text", F.lit("\n3. third"))).otherwise(F.col("text")))
    path, out, checkpoint = (tempfile.mkdtemp(prefix="spark-docs-") for _ in range(3))
    docs.where(F.col("doc_id") < ids[-1]).coalesce(1).write.mode("append").parquet(path)
    changed.where(F.col("doc_id").isin(ids[0], ids[1], ids[-1])).coalesce(1).write.mode("append").parquet(path)

    def lay_out(texts):
        rows = corpus.set_rows(corpus.lines_of_texts(texts))
        return corpus.explode_glyphs(rows), corpus.grid_pages(rows)

    store = incremental.DocumentStore(spark, out, incremental.conversion_stages(lay_out))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    incremental.document_stream(stream, store, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert store.batches() == [0, 1]
    assert {r.doc_id for r in spark.read.parquet(f"{out}/lines/batch=1").select("doc_id").distinct().collect()} == {ids[1], ids[-1]}
    whole = convert.convert(*lay_out(changed))
    for name, found in whole.items():
        columns = sorted(found.columns)
        rows = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())  # noqa: B023, E731
        assert rows(store.rows(name)) == rows(found), name


def test_sources_and_csv(spark, folder):
    from quireflow.operators import export
    from quireflow.sources.tables import list_sources

    files = list_sources(spark, [folder], "*.parquet")
    assert files.count() == 14 and "content" not in files.columns
    path = tempfile.mkdtemp(prefix="spark-csv-") + "/out"
    export.write_usage_csv(corpus.usage(spark, folder), path)
    assert spark.read.csv(path, header=True).columns[0].endswith("time")


def _bundle_flips(spark, streams, snapshot=None, name="bundle_flips_seen"):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for key, value in bundles.BUNDLE_STREAM_CONF.items():
        spark.conf.set(key, value)
    try:
        out = bundles.bundle_stream(streams, "300 days", snapshot)
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted((r.bundle, r.ts, r.ready, r.members) for r in spark.table(name).collect())


def _in_triggers(spark, events, parts):
    """The events in so many files and as many triggers, out of order, and a last one that moves the watermark past all."""
    path = tempfile.mkdtemp(prefix="spark-stream-")
    for part in range(parts):
        events.where(F.abs(F.hash("id")) % parts == part).orderBy(F.hash("id", "job")).coalesce(1).write.mode("append").parquet(path)
    end = spark.createDataFrame([("~", "~", -1, "2026-01-01 00:00:00", "tick", None)], "bundle string, job string, id bigint, ts string, event string, until timestamp")
    end.withColumn("ts", F.col("ts").cast("timestamp")).select(*events.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bundle_stream(spark, folder):
    """Two streams, shuffled over three triggers each, give the flips of the finished log, ends of windows included."""
    events = bundle_events(spark, folder).where("event is not null")
    expected = sorted((r.bundle, r.ts, r.ready, r.members) for r in bundles.bundle_flips(events).collect())
    streams = [_in_triggers(spark, events.where("event in ('member', 'close')"), 3), _in_triggers(spark, events.where("event not in ('member', 'close')"), 3)]
    assert _bundle_flips(spark, streams) == expected
    known = {(r.bundle, r.ts) for r in events.collect()}
    assert any((bundle, ts) not in known for bundle, ts, ready, _ in expected if not ready) and {ready for _, _, ready, _ in expected} == {True, False}


def test_bundle_stream_from_snapshot(spark, folder):
    """What came before an instant as a batch, what came later as a stream."""
    events, asof = bundle_events(spark, folder).where("event is not null"), "2024-01-12 00:00:00"
    flips = sorted((r.bundle, r.ts, r.ready, r.members) for r in bundles.bundle_flips(events).where(F.col("ts") > F.lit(asof).cast("timestamp")).collect())
    later = _in_triggers(spark, events.where(F.col("ts") > F.lit(asof).cast("timestamp")), 2)
    assert flips and _bundle_flips(spark, [later], bundles.bundle_snapshot(events, asof), "bundle_flips_later") == flips


def test_bundle_flips_small(spark):
    def run(rows):
        schema = "bundle string, job string, id bigint, ts bigint, event string, until bigint"
        events = spark.createDataFrame(rows, schema).withColumns({c: F.timestamp_seconds(c) for c in ("ts", "until")})
        return [(r.bundle, r.s, r.ready, r.members) for r in bundles.bundle_flips(events).select("bundle", (F.unix_micros("ts") / 1e6).alias("s"), "ready", "members").orderBy("bundle", "s").collect()]

    member = [("b", "j", 1, 0, "member", None), ("b", "k", 2, 0, "member", None)]
    assert run(member) == []
    both = member + [("b", "j", 3, 10, "convert", 100), ("b", "k", 4, 20, "convert", 50)]
    assert run(both) == [("b", 20, True, 2), ("b", 50.000001, False, 2)]
    # another conversion keeps the window open, a late member closes it, its conversion opens it again
    assert run(both + [("b", "k", 5, 50, "convert", 70)]) == [("b", 20, True, 2), ("b", 70.000001, False, 2)]
    assert run(both + [("b", "l", 6, 30, "member", None), ("b", "l", 7, 40, "convert", 41)]) == [("b", 20, True, 2), ("b", 30, False, 3), ("b", 40, True, 3), ("b", 41.000001, False, 3)]
    assert run(both + [("b", "l", 7, 30, "convert", 90), ("b", "l", 6, 40, "member", None)]) == [("b", 20, True, 2), ("b", 50.000001, False, 3)]
    # deleted and converted in one instant: the last counts; an unknown event and a job of no bundle count for nothing
    assert run(both + [("b", "j", 8, 30, "delete", None), ("b", "j", 9, 30, "convert", 60), ("b", "x", 10, 25, "convert", 60), ("b", "j", 11, 26, "view", None)]) == [("b", 20, True, 2), ("b", 50.000001, False, 2)]
    assert run(both + [("b", "j", 9, 30, "convert", 60), ("b", "j", 10, 30, "delete", None)]) == [("b", 20, True, 2), ("b", 30, False, 2)]
    # closed, and opened anew under the same name
    assert run(both + [("b", "", 12, 30, "close", None), ("b", "j", 13, 31, "member", None), ("b", "j", 14, 32, "convert", 33)]) == [
        ("b", 20, True, 2), ("b", 30, False, 0), ("b", 32, True, 1), ("b", 33.000001, False, 1)]
