"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are dealt into blocks of bounded size. In a block every dimension is a posting list ordered by value and cut
into segments of equal quantised impact. A query takes the segments of all lists in descending order of what they can
still add to a score, and stops when the vectors that can still be among its k best are few; those are scored exactly.
Query blocks meet vector blocks, so no task holds more than one of each, and only k rows a query leave a pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quireflow.session import settle

BLOCK_ROWS = 16384
QUERY_ROWS = 512
LEVELS = 16


def components(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(parts: list, width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), np.int64)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def _index_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    width = max(map(len, rows["parts"]))
    values = _matrix(list(rows["parts"]), width)
    order = np.argsort(-values.T, axis=1, kind="stable").astype(np.int32)
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "width": [width], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
                         "vectors": [values.tobytes()], "postings": [order.tobytes()]})


class _Block:
    """One block of the index, ready for queries."""

    def __init__(self, row: pd.Series):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n, width = len(self.ids), int(row["width"])
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, width)
        self.order = np.frombuffer(row["postings"], np.int32).reshape(width, n)
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.cuts = [self._segments(v) for v in self.values]  # of a list in descending order

    @staticmethod
    def _segments(values: np.ndarray) -> np.ndarray:
        low, span = values[-1], values[0] - values[-1] + 1
        level = (values - low) * LEVELS // span
        return np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(values)]))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors of the block other than the query's own, ties to smaller ids."""
        n, width = self.vectors.shape
        own = self.ids == query_id
        possible = np.flatnonzero(~own)
        query = np.pad(query, (0, max(0, width - len(query))))[:width]
        if len(possible) > 4 * k and query.any():
            possible = self._possible(own, query, k)
        scores = self.vectors[possible] @ query
        first = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible[first]], scores[first]

    def _possible(self, own: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
        """The vectors that can be among the k best: a superset of them, found from a part of the postings.

        Scores count from each list's smallest contribution, so what a list has not yet said about a vector is between
        zero and the bound of its next segment. `rest` is the sum of those bounds: no vector can still gain more.
        """
        lists, starts, stops, bounds, falls = [], [], [], [], []
        for d in np.flatnonzero(query):
            cuts, gain = self.cuts[d], query[d] * self.values[d]
            if query[d] > 0:
                a, b, low = cuts[:-1], cuts[1:], gain[-1]
                top = gain[a] - low
            else:
                a, b, low = cuts[:-1][::-1], cuts[1:][::-1], gain[0]
                top = gain[b - 1] - low
            lists.append(np.full(len(a), d))
            starts.append(a)
            stops.append(b)
            bounds.append(top)
            falls.append(top - np.append(top[1:], 0))
        lists, starts, stops, bounds, falls = map(np.concatenate, (lists, starts, stops, bounds, falls))
        turn = np.argsort(-bounds, kind="stable")
        rest = falls.sum() - np.cumsum(falls[turn])
        low_of = {d: (query[d] * self.values[d][[0, -1]]).min() for d in np.unique(lists)}
        found = np.zeros(len(own), np.int64)
        found[own] = -(1 << 62)
        check, few = rest[0] * 3 // 4, max(4 * k, len(own) // 64)
        possible = np.flatnonzero(~own)
        for step, s in enumerate(turn):
            d = lists[s]
            found[self.order[d, starts[s]:stops[s]]] += query[d] * self.values[d, starts[s]:stops[s]] - low_of[d]
            if rest[step] <= check or step == len(turn) - 1:
                floor = np.partition(found, -k)[-k]
                possible = np.flatnonzero(found + rest[step] >= floor)
                if len(possible) <= few:
                    break
                check = rest[step] * 7 // 8
        return possible


def _answer(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            block = _Block(index.iloc[0])
            for query_id, parts in zip(queries["query_id"], queries["parts"], strict=True):
                ids, scores = block.best(query_id, np.asarray(parts, np.int64), k)
                out.append(pd.DataFrame({"query_id": np.full(len(ids), query_id, np.int64), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return run


def build_index(vectors: DataFrame) -> DataFrame:
    """block, width, ids, vectors, postings: one row for each block of about BLOCK_ROWS of (vec_id, parts)."""
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return settle(dealt.groupBy("block").applyInPandas(_index_block, "block int, width int, ids binary, vectors binary, postings binary"))


def top_k(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    `is_query` is a condition on `rows`. Candidates are all rows but the query's own; fewer than k are returned whole.
    Vectors that are null or hold a null or non-finite component, and rows without a key, take no part. Of rows that
    share a key the one with the largest components is used. Vectors of other lengths count as filled up with zeros.
    Scores are 64-bit. Other columns are ignored. An empty table gives an empty result.
    """
    valid = (rows.select(F.col(key).cast("bigint").alias("vec_id"), components(F.col(vector), scale).alias("parts"), F.coalesce(is_query, F.lit(False)).alias("asks"))
             .where("vec_id IS NOT NULL AND parts IS NOT NULL AND size(parts) > 0"))
    valid = settle(valid.groupBy("vec_id").agg(F.max("parts").alias("parts"), F.max("asks").alias("asks")))
    index = build_index(valid.select("vec_id", "parts"))
    queries = valid.where("asks").select(F.col("vec_id").alias("query_id"), "parts")
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    blocks = index.agg(F.max("block")).first()[0] or 0
    grouped = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    asked = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    best = (held.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
            .applyInPandas(_answer(k), "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
