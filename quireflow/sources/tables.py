"""Reading the input tables and checking them against their declared schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def table_bytes(spark: SparkSession, folder: str, name: str) -> int:
    """Size of a given table's files, as its file system tells it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"{name}.parquet"))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


# Canonical schemas of page primitives.
PRIMITIVES: dict[str, str] = {
    "glyphs": (
        "doc_id BIGINT, page INT, frag INT, gno INT, c STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE,"
        " font STRING, flags INT, char_flags INT, rgb INT, icon STRING, conf DOUBLE, ink DOUBLE"
    ),
    "paths": (
        "doc_id BIGINT, page INT, draw_ord INT, item_ord INT, op STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE,"
        " width DOUBLE, type STRING, stroke ARRAY<DOUBLE>, fill ARRAY<DOUBLE>, fill_opacity DOUBLE"
    ),
    "images": (
        "doc_id BIGINT, page INT, img INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, digest STRING, is_blank BOOLEAN,"
        " sample ARRAY<FLOAT>"
    ),
    "pages": ("doc_id BIGINT, page INT, width DOUBLE, height DOUBLE"),
}
KEYS = {"glyphs": ["doc_id", "page", "frag", "gno"], "paths": ["doc_id", "page", "draw_ord", "item_ord"],
        "images": ["doc_id", "page", "img"], "pages": ["doc_id", "page"]}


def load_primitives(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Reads the primitive tables under their declared schemas; a missing or mistyped column fails at read time."""
    return {name: spark.read.schema(schema).parquet(os.path.join(folder, name)) for name, schema in PRIMITIVES.items()}


def key_violations(primitives: dict[str, DataFrame]) -> DataFrame:
    """Rows with a null key and keys used more than once, counted per table."""
    parts = []
    for name, df in primitives.items():
        keys = KEYS[name]
        null_key = F.lit(False)
        for key in keys:
            null_key = null_key | F.col(key).isNull()
        nulls = df.where(null_key).agg(F.count("*").alias("null_keys"))
        repeats = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
        parts.append(nulls.crossJoin(repeats).select(F.lit(name).alias("table_name"), "null_keys", "repeated_keys"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asks the file system the path names, whatever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def list_sources(spark: SparkSession, paths: list[str], pattern: str = "*.pdf") -> DataFrame:
    """Input files in order: a file stays as it is, a folder becomes its matching files sorted by path.

    Only paths and lengths are read; the content column is pruned before the scan.
    """
    parts = []
    for i, path in enumerate(paths):
        reader = spark.read.format("binaryFile")
        if _is_folder(spark, path):
            reader = reader.option("pathGlobFilter", pattern)
        parts.append(reader.load(path).select(F.lit(i).alias("input_ord"), "path", "length"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_sources(files: DataFrame, keys: list[str], ties: list[str], width: int = 3) -> DataFrame:
    """Position of each file inside its input, by path.

    A prefix of the path orders like the path, so it is the chunk. It reaches `width` characters past what all paths of
    the input start with, which their smallest and largest show.
    """
    from quireflow.functions import scan

    ends = files.groupBy(*keys).agg(F.min("path").alias("__low"), F.max("path").alias("__high"))
    place = F.sequence(F.lit(1), F.least(F.length("__low"), F.length("__high")) + 1)
    shared = F.get(F.filter(place, lambda k: F.substring("__low", F.lit(1), k) != F.substring("__high", F.lit(1), k)), 0)
    ends = ends.select(*keys, (F.coalesce(shared, F.length("__low")) + width).alias("__reach"))
    reached = files.join(ends, keys).withColumn("prefix", F.expr("substring(path, 1, __reach)")).drop("__reach")
    return scan.numbered(reached, keys, ["prefix"], ["path", *ties], "ord")


def list_presets(spark: SparkSession, folder: str) -> DataFrame:
    """The preset dimension: id (file name), display name and fonts, by id."""
    raw = spark.read.option("multiLine", True).schema(
        "name STRING, runs STRING, fonts ARRAY<STRING>"
    ).json(folder).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return raw.select(stem.alias("id"), F.coalesce("name", stem).alias("name"), "runs", "fonts").orderBy("id")
