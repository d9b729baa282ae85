"""Continuous usage summary and failure store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.operators import usage as ops


def usage_stream(usage: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Daily summary per user of a usage stream; rows later than the watermark are dropped. Use update mode."""
    done = F.col("event").isin(*ops.CONVERSIONS)
    return daily_usage(usage.withWatermark("ts", lateness), done)


def daily_usage(usage: DataFrame, done=None) -> DataFrame:
    """The aggregation of usage_stream, also for finished logs."""
    done = F.col("event").isin(*ops.CONVERSIONS) if done is None else done
    return usage.groupBy(F.window("ts", "1 day").alias("day"), "user").agg(
        F.count_if(done).alias("conversions"), *[F.sum(F.when(done, F.col(c)).otherwise(0)).cast("long").alias(c) for c in ("files", "pages", "questions")],
        F.count_if((F.col("event") == "error") | (F.col("status") == "FAIL")).alias("errors"), F.count_if(F.col("event") == "download").alias("downloads"),
    ).select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "user", "conversions", "files", "pages", "questions", "errors", "downloads")


def samples_stream(failures: DataFrame, store: str, checkpoint: str, **limits):
    """Keeps the failure store up to date: each micro-batch is folded into the newest version and pruned.

    A batch writes a version folder named by its id and reads the one before it, so a batch that is run again after a lost
    executor or driver gives the same store. Versions before that one are removed.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = spark.read.parquet(f"{store}/version={batch_id - 1}").unionByName(batch.withColumns({"count": F.lit(1).cast("long"), "first_ts": F.col("ts")}), allowMissingColumns=True)
        merged = ops.upsert_samples(rows)
        if limits:
            merged = ops.prune_samples(merged, **limits)
        merged.write.mode("overwrite").parquet(f"{store}/version={batch_id}")
        root = spark._jvm.org.apache.hadoop.fs.Path(store)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("version=") and int(name.removeprefix("version=")) < batch_id - 1:
                files.delete(status.getPath(), True)

    return failures.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
