"""Exact dedup over a persistent index of text digests.

The index is a Parquet table, bucketed by digest and sorted by it within a bucket, in a folder all executors share. New
rows are reduced to one row per digest before any join, meet the index in a sort-merge anti-join that does not shuffle
the index, and what is new is appended. Absorbing the same rows again changes nothing, so a batch whose driver was lost
can be run once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.session import settle


def digest_of(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far, each with the id of the row that stays.

    `location` is a folder all executors share; opening the same folder under any table name, in any session, continues
    the index. `buckets` is fixed when the index is made: take about one per 100 MB of digests expected.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forgets the table; the files in its folder stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def absorb(self, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Adds the texts of `rows` and returns key, digest, keep_id, group_size, kept: one row for each row given.

        A digest the index holds already keeps its row; else the largest key of its new rows stays. group_size counts
        the new rows of a digest. Null keys are smaller than any key; a group of null keys alone has a null keep_id
        and its rows are kept. Rows repeated with key and text get the same decision. No row in, no row out. Columns
        other than the two named are ignored, so their names cannot clash.
        """
        digests = settle(rows.select(F.col(key).cast("bigint").alias("key"), digest_of(F.col(text)).alias("digest")))
        groups = digests.groupBy("digest").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = settle(groups)
        fresh = groups.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(self.name)
        stays = settle(groups.drop("keep_id").join(self.rows(), "digest"))
        # one row per digest against all rows: both sides are shuffled for this join alone, so a hot digest can be split
        out = digests.join(stays, "digest")
        return out.select(F.col("key").alias(key), "digest", "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"))


def plain_key(key: str) -> Column:
    """The key as a string, empty for null: equal for equal keys, null included."""
    return F.coalesce(F.col(key).cast("bigint").cast("string"), F.lit(""))


def only_these(rows: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """Rows that agree with a row of `wanted` on the named columns, one of those that agree with each other.

    The rows are shuffled once: for the join, which leaves them as the removal of repeats needs them.
    """
    return rows.join(wanted.select(*names), names, "left_semi").dropDuplicates(names).drop(*names)


def keep_first_copies(rows: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose decision is to stay, whole; of rows repeated with key and text one stays.

    Joined on key and digest together, which spreads the copies of a hot text over all tasks.
    """
    stay = decisions.where("kept").select(plain_key(key).alias("__key"), F.col("digest").alias("__digest"))
    return only_these(rows.withColumn("__key", plain_key(key)).withColumn("__digest", digest_of(F.col(text))), stay, ["__key", "__digest"])
