"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

A text's features are its words and their stems, pairs of neighbours and pairs with one word between, each hashed to one
of 2**BITS places and counted once. Learning runs in shards of bounded size over a bounded sample of the labelled rows; each shard
runs FTRL-proximal (a learning rate for each coordinate, L1 and L2), and the model is the mean of the shards' weights.
L1 leaves few weights other than zero, so the model is small enough to go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import in_arrow, text_blocks
from quireflow.session import settle

BITS = 22
SHARD_ROWS = 8192
MAX_TRAIN_ROWS = 65536
STEMS = (4, 5, 6, 7)

_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Position of the text, and place, of each feature, repeats included.

    A word is a run of lower-cased ASCII letters and digits and of characters outside ASCII. Its first 4 to 7 bytes
    stand for its stem, so that inflected forms not seen in training still count.
    """
    parts = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.concatenate(([False], _WORD_BYTE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    a, b = edges[::2], edges[1::2]
    # hash of bytes a..b: a difference of prefix sums, moved back to place 0
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_P, "up", len(raw)), dtype=np.uint64)))
    word = _mixed((prefix[b] - prefix[a]) * _power(_P_INV, "down", len(raw) + 1)[a])
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))), a, side="right")
    near, skip = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    pair = _mixed(word[:-1] * np.uint64(3) + word[1:] * np.uint64(5))[near]
    gap = _mixed(word[:-2] * np.uint64(7) + word[2:] * np.uint64(11))[skip]
    docs, hashes = [doc, doc[:-1][near], doc[:-2][skip]], [word, pair, gap]
    back = _power(_P_INV, "down", len(raw) + 1)
    for length in STEMS:
        long = b - a > length
        head = a[long]
        docs.append(doc[long])
        hashes.append(_mixed((prefix[head + length] - prefix[head]) * back[head] * np.uint64(13) + np.uint64(length)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """Weights other than zero, by place in ascending order, and the bias."""

    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0


def _ftrl(texts: list[np.ndarray], labels: np.ndarray, rounds: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """z-state turned to weights, after `rounds` passes; the last place is the bias, which has no penalty."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    penalty = np.float32(l1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        small = np.sign(z) * np.maximum(np.abs(z) - penalty, 0)
        return -small / ((beta + np.sqrt(n)) / alpha + l2)

    z_bias = n_bias = 0.0
    for _ in range(rounds):
        for own, y in zip(texts, labels, strict=True):
            z_own, n_own = z[own], n[own]
            w = weights(z_own, n_own)
            bias = -z_bias * alpha / (beta + n_bias ** 0.5)
            p = 1 / (1 + np.exp(-np.clip(w.sum(dtype=np.float64) + bias, -30, 30)))
            g = p - y
            z[own] = z_own + g - (np.sqrt(n_own + g * g) - np.sqrt(n_own)) / alpha * w
            n[own] = n_own + g * g
            z_bias += g - (((n_bias + g * g) ** 0.5 - n_bias ** 0.5) / alpha) * bias
            n_bias += g * g
    found = np.flatnonzero(np.abs(z) > penalty)
    places = np.append(found, size - 1)
    return places, np.append(weights(z[found], n[found]), -z_bias * alpha / (beta + n_bias ** 0.5))


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train_rows: int = MAX_TRAIN_ROWS,
        shard_rows: int = SHARD_ROWS, rounds: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0) -> Model:
    """Learns from the texts of `rows` that `labels` marks 0 or 1; a label of null, or another number, is left out.

    About max_train_rows labelled keys are used, those of the smallest hashes; all of them if there are fewer. Of several
    labels of a key the largest holds. The keys with their labels are broadcast: at most about max_train_rows of 16
    bytes. The model has at most 2**BITS weights.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
             .groupBy(F.col(key).cast("bigint").alias("__key")).agg(F.max(label).cast("int").alias("__label")))
    known = settle(known)
    count = known.count()
    share = min(1.0, max_train_rows / max(count, 1))
    spread = 1 << 30
    known = known.where(F.pmod(F.xxhash64("__key"), F.lit(spread)) < int(share * spread))
    shards = max(1, -(-min(count, max_train_rows) // shard_rows))
    chosen = (rows.select(F.col(key).cast("bigint").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
              .join(F.broadcast(known), "__key").repartition(shards, F.xxhash64("__key"))
              # learned in the order of a hash, so neither the layout of the input nor a task run again changes the model
              .sortWithinPartitions(F.xxhash64("__key", F.lit("order")), "__key", F.xxhash64("text"), "text"))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        texts: list[np.ndarray] = []
        marks: list[int] = []
        for batch, block in text_blocks(batches, "text"):
            doc, place = features(block)
            pairs = np.unique(doc << BITS | place)
            ends = np.searchsorted(pairs >> BITS, np.arange(1, len(block)))
            texts += [x.astype(np.int32) for x in np.split(pairs & (1 << BITS) - 1, ends)]
            marks += batch["__label"].to_pylist()
        if texts:
            places, weights = _ftrl(texts, np.array(marks), rounds, alpha, beta, l1, l2)
            yield {"place": places, "weight": weights.astype(np.float64), "shard": np.full(len(places), 1)}

    # a place has one weight of each shard; added up in one order, so that the sums don't differ in their last digits
    found = in_arrow(chosen.select("__key", "text", "__label"), work, "place bigint, weight double, shard bigint").groupBy("place").agg(
        F.array_sort(F.collect_list("weight")).alias("weights"), F.sum("shard").alias("shards"))
    sums = found.select("place", F.aggregate("weights", F.lit(0.0), lambda total, w: total + w).alias("weight"), "shards")
    found = sums.toPandas().sort_values("place")
    if not len(found):
        return Model()
    trained = int(found["shards"].iloc[-1])  # each shard with rows gives a bias
    places, weights = found["place"].to_numpy(np.int64), found["weight"].to_numpy() / trained
    return Model(places[:-1], weights[:-1].astype(np.float32), float(weights[-1]))


def score(rows: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of `keep`, then score (0 to 1, double): one row for each row given.

    A null or empty text, or one without a word, gets the score of the bias alone. Texts are read whole. Repeated rows
    give repeated results; an empty model scores 0.5 everywhere.
    """
    chosen = rows.select(*[column.alias(name) for name, column in keep.items()], F.col(text).alias("__text"))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.places] = model.weights
        for batch, texts in text_blocks(batches, "__text"):
            doc, place = features(texts)
            counts = dense[place] != 0
            pairs = np.unique(doc[counts] << BITS | place[counts])
            total = np.bincount(pairs >> BITS, dense[pairs & (1 << BITS) - 1], len(texts)) + model.bias
            yield {n: c for n, c in batch.items() if n != "__text"} | {"score": 1 / (1 + np.exp(-np.clip(total, -30, 30)))}

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text"]
    return in_arrow(chosen, work, ", ".join([*fields, "score double"]))
