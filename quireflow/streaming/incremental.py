"""Documents kept up to date through dependent stages: only what changed is computed again.

A manifest says, for each document and stage, from which content and by which version of the stage the stored rows were
made, and in which batch. A document runs through a stage again if its content, the stage, or a stage that it uses has
changed. A batch writes the rows of each stage to a folder of its own and then its manifest by one rename: before that
no reader sees the batch, after it all of it. A batch that is run again finds its manifest and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.session import release, settle

MANIFEST = "doc_id bigint, stage string, digest string, version string"


@dataclass(frozen=True)
class Stage:
    """A step of the work. `run` takes the documents and the rows of the stages named in `uses`, in that order.

    All it is given belongs to the documents to be computed; what it returns has doc_id. `version` is changed whenever
    `run` is.
    """

    name: str
    version: str
    run: Callable[..., DataFrame]
    uses: Sequence[str] = ()


class DocumentStore:
    """Rows of all stages of all documents in one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, stages: Sequence[Stage]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), list(stages)
        self.versions: dict[str, str] = {}
        for stage in self.stages:
            # a stage must come behind those it uses
            parts = [stage.name, stage.version, *(self.versions[name] for name in stage.uses)]
            self.versions[stage.name] = hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Batches that are whole."""
        files, root = self._files(), self._path("manifest")
        names = [status.getPath().getName() for status in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))

    def manifest(self) -> DataFrame:
        """doc_id, stage, digest, version, batch: where the rows of each document and stage are. One row each."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], f"{MANIFEST}, batch int")
        rows = self.spark.read.option("basePath", f"{self.folder}/manifest").schema(f"{MANIFEST}, batch int").parquet(*[f"{self.folder}/manifest/batch={k}" for k in done])
        newest = F.max_by(F.struct("digest", "version", "batch"), "batch")
        return rows.groupBy("doc_id", "stage").agg(newest.alias("m")).select("doc_id", "stage", "m.*")

    def rows(self, stage: str, ids: DataFrame | None = None) -> DataFrame:
        """Current rows of a stage, of all documents or of those in `ids`.

        Only the folders of batches that the manifest still points to are read.
        """
        where = self.manifest().where(F.col("stage") == stage).select("doc_id", "batch")
        if ids is not None:
            where = where.join(ids.select("doc_id"), "doc_id", "left_semi")
        # one row for each batch
        used = [r["batch"] for r in where.select("batch").distinct().collect()]
        if not used:
            raise LookupError(f"nothing is stored for {stage}")
        stored = self.spark.read.option("basePath", f"{self.folder}/{stage}").parquet(*[f"{self.folder}/{stage}/batch={k}" for k in sorted(used)])
        return stored.join(where, ["doc_id", "batch"], "left_semi").drop("batch")

    def update(self, documents: DataFrame, batch: int, text: str = "text") -> dict[str, int]:
        """Brings the store up to date with these documents; how many ran through each stage.

        Of rows with one doc_id that of the largest digest counts, rows without one are left out, a null text is an empty
        one. Documents not named stay as they are, also if a stage has another version by now.
        """
        if batch in self.batches():
            return {stage.name: 0 for stage in self.stages}
        named = documents.where("doc_id is not null").withColumn(text, F.coalesce(text, F.lit("")))
        wanted = named.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.sha2(text, 256)).alias("digest"))
        versions = F.array(*[F.struct(F.lit(name).alias("stage"), F.lit(version).alias("version")) for name, version in self.versions.items()])
        known = self.manifest().withColumnsRenamed({"digest": "k_digest", "version": "k_version"})
        stale = wanted.select("doc_id", "digest", F.inline(versions)).join(known, ["doc_id", "stage"], "left").where(
            ~(F.col("k_digest").eqNullSafe(F.col("digest")) & F.col("k_version").eqNullSafe(F.col("version"))))
        todo = settle(stale.select("doc_id", "stage", "digest", "version"))
        counts = {r["stage"]: r["n"] for r in todo.groupBy("stage").agg(F.count("*").alias("n")).collect()}
        changed = todo.select("doc_id", "digest").distinct()
        texts = settle(named.withColumn("digest", F.sha2(text, 256)).join(changed, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).drop("digest"))
        for stage in self.stages:
            if not counts.get(stage.name):
                continue
            ids = todo.where(F.col("stage") == stage.name).select("doc_id")
            inputs = [self._input(name, ids, todo, batch) for name in stage.uses]
            found = stage.run(texts.join(ids, "doc_id", "left_semi"), *inputs)
            found.write.mode("overwrite").parquet(f"{self.folder}/{stage.name}/batch={batch}")
        self._commit(todo, batch)
        release(texts)
        release(todo)
        return {stage.name: counts.get(stage.name, 0) for stage in self.stages}

    def _input(self, name: str, ids: DataFrame, todo: DataFrame, batch: int) -> DataFrame:
        """Rows of a stage for some documents: those of this batch, and for the others what is stored."""
        fresh_ids = todo.where(F.col("stage") == name).select("doc_id")
        stored_ids = ids.join(fresh_ids, "doc_id", "left_anti")
        fresh = None
        if fresh_ids.limit(1).count():
            fresh = self.spark.read.parquet(f"{self.folder}/{name}/batch={batch}").join(ids, "doc_id", "left_semi")
        if not stored_ids.limit(1).count():
            return fresh
        stored = self.rows(name, stored_ids)
        return stored if fresh is None else fresh.unionByName(stored)

    def _commit(self, todo: DataFrame, batch: int) -> None:
        files, pending, final = self._files(), f"pending/batch={batch}", f"manifest/batch={batch}"
        todo.write.mode("overwrite").parquet(f"{self.folder}/{pending}")
        files.mkdirs(self._path("manifest"))
        if not files.rename(self._path(pending), self._path(final)):
            raise OSError(f"{final} could not be put in place")

    def vacuum(self) -> list[str]:
        """Removes the folders of rows that no document points to any more, and of batches never finished."""
        used = {(r["stage"], r["batch"]) for r in self.manifest().select("stage", "batch").distinct().collect()}
        files, gone = self._files(), []
        for stage in self.stages:
            root = self._path(stage.name)
            for status in files.listStatus(root) if files.exists(root) else []:
                name = status.getPath().getName()
                if name.startswith("batch=") and (stage.name, int(name.removeprefix("batch="))) not in used:
                    files.delete(status.getPath(), True)
                    gone.append(f"{stage.name}/{name}")
        return sorted(gone)


def conversion_stages(lay_out: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> list[Stage]:
    """The stages of convert() over documents; `lay_out` gives their glyphs and pages."""
    from quireflow.operators import convert

    return [
        Stage("lines", "1", lambda docs: convert.lines_of(*lay_out(docs))),
        Stage("structured", "1", lambda docs, lines: convert.structure_of(lines), ("lines",)),
        Stage("units", "1", lambda docs, structured: convert.units_of(structured), ("structured",)),
        Stage("checks", "1", lambda docs, lines, structured, units: convert.checks_of(lines, structured, units), ("lines", "structured", "units")),
    ]


def document_stream(documents: DataFrame, store: DocumentStore, checkpoint: str):
    """Keeps a store up to date with a stream of documents: each micro-batch is one batch of the store."""
    return documents.writeStream.foreachBatch(lambda rows, batch: store.update(rows, batch) and None).option("checkpointLocation", checkpoint)
