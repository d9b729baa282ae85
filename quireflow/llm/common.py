"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str) -> Column:
    """True for ids whose crc32 leaves 0 modulo 5. Rows without an id count as held out: nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def in_arrow(rows: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Runs work over the record batches of each partition, as dictionaries of Arrow columns in and of lists or arrays out."""
    names = rows.columns
    target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for batch in batches:
                if batch.num_rows:
                    yield {name: batch.column(k) for k, name in enumerate(names)}

        for out in work(columns()):
            arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], None if isinstance(out[f.name], np.ndarray) else f.type) for f in target]
            yield from pa.table(arrays, names=target.names).cast(target).to_batches()

    return rows.mapInArrow(run, schema)


def text_blocks(columns: Iterator[dict], name: str = "text", chars: int = 1 << 21) -> Iterator[tuple[dict, list[str]]]:
    """Slices of the batches whose texts have about `chars` characters together; a null text counts as empty.

    Bounds what a vectorised step holds at once. A single longer text is a slice of its own and stays whole.
    """
    for batch in columns:
        texts = batch[name].to_pylist()
        start = size = 0
        for k, text in enumerate(texts):
            length = len(text or "") + 64
            if k > start and size + length > chars:
                yield {n: c.slice(start, k - start) for n, c in batch.items()}, [t or "" for t in texts[start:k]]
                start, size = k, 0
            size += length
        yield {n: c.slice(start) for n, c in batch.items()}, [t or "" for t in texts[start:]]
