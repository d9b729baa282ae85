"""Session settings the library relies on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (time zone) or the plans the operators are written for. Files of keys and bounds shrink by
# far, so a plan takes a file for FILE_FACTOR times its size before it sends the rows through the driver to every task;
# what is really small is found by adaptive execution after its shuffle.
FILE_FACTOR = 32
SETTINGS = {
    "spark.sql.sources.fileCompressionFactor": str(float(FILE_FACTOR)),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Rows dealt by document or page meet other rows of it where they are, by whatever more they are joined. The queries of
# quireflow.llm keep Spark's default.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quireflow")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in (SETTINGS | {CO_PARTITION: "false"}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession, all_keys: bool = False) -> None:
    """Sets the result-relevant settings on a session made elsewhere; all_keys: joins deal rows by all of their keys."""
    for key, value in (SETTINGS | {CO_PARTITION: str(all_keys).lower()}).items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder iterative operators checkpoint to.

    The cluster names it in spark.checkpoint.dir. Only a local master, where driver and executors share one machine,
    may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-quireflow-")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared checkpoint folder and reads it back.

    Cuts the lineage of iterative work. Unlike checkpoint(), which runs the plan once for the rows and once more for the
    files, the plan runs once, and the files carry statistics for the next round. A lost executor only costs a re-read.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    written.settled_in = folder
    return written


def release(settled: DataFrame) -> None:
    """Removes the files of a settled result that no later plan reads."""
    where = settled.sparkSession._jvm.org.apache.hadoop.fs.Path(settled.settled_in)
    where.getFileSystem(settled.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
