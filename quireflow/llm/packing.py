"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document's ids are cut into full sequences and a rest; the rest is cut until what is left over fills a whole number of
times nearly the capacity. A piece of class k is longer than capacity/(k+1) and at most capacity/k, so k of them always
fit a sequence: sequence and place follow from a piece's number in its class, which each chunk of pieces counts on its
own. Only the last sequence of each class can stay open; the pieces of those, a number set by the capacity alone, are
put together largest first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quireflow.llm.common import in_arrow, text_blocks
from quireflow.session import settle

CAPACITY = 4096
CHUNK_PIECES = 200_000
_CACHED_WORDS, _CACHED_IDS = 700_000, 6_000_000


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of so many tokens.

    A rest that k times leaves at most a 64th of the capacity empty stays whole. Else a piece that fits k + 1 times is
    taken off, which leaves less than capacity/(k*(k+1)): a few cuts at most.
    """
    pieces, rest = [capacity] * (tokens // capacity), tokens % capacity
    while rest:
        fit = capacity // rest
        size = rest if capacity - fit * rest <= capacity // 64 else capacity // (fit + 1)
        pieces.append(size)
        rest -= size
    return pieces


# Signs of which a run at the end of a word is a part of its own for the tokenizer, whatever letter or digit stands before.
_ENDS = ".,;:!?*$%&#|()"


class _Ids:
    """Ids of strings, one after the other in one array, by the number of the string."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def add(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered strings, joined, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        total = np.cumsum(sizes)
        return self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)], sizes


class WordTokens:
    """Ids of texts, each distinct blank-separated part tokenised once.

    Only for tokenizers that lower-case, treat white space as a boundary and drop it, and never join letters or digits
    with the signs that follow: then parts between blanks or line feeds, and the signs at their ends, have the ids that
    they have in the whole text. What is known is kept from task to task, up to a fixed number of parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text with the string of an added token is encoded whole: the tokenizer looks for those before all else
        self.added = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.units = _Ids(), _Ids()

    def _learn_units(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.units.known]
        plain = [u for u in new if u.isalpha() and "\u0130" not in u]
        if plain:
            # one text of all words: each is one part for the tokenizer, told apart by its number
            found = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(plain))
            if len(sizes) == len(plain) and sizes.all():
                self.units.add(plain, np.array(found.ids, np.uint32), sizes)
            else:
                plain = []
        rest = [u for u in new if u not in self.units.known]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.units.add(rest, np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum())), sizes)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words.known]
        parts = []
        for w in new:
            base = w.rstrip(_ENDS)
            parts += (base, w[len(base):]) if base and base[-1].isalnum() and base[-1] != "\u0130" else (w, "")
        self._learn_units(set(parts))
        known = self.units.known
        ids, sizes = self.units.take(np.fromiter((known[p] for p in parts), np.int64, len(parts)))
        self.words.add(new, ids, sizes.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words.known) > _CACHED_WORDS or len(self.words.ids) > _CACHED_IDS:
            self.words = _Ids()
        if len(self.units.known) > _CACHED_WORDS or len(self.units.ids) > _CACHED_IDS:
            self.units = _Ids()
        # these two letters are lower-cased otherwise than by the tokenizer, the first to a letter and a mark
        lowered = [t if "\u0130" in t or "\u03a3" in t else t.lower() for t in texts]
        whole = {k for k, t in enumerate(lowered) if any(token in t.lower() for token in self.added)} if self.added else set()
        parts = [[] if k in whole else t.replace("\n", " ").split(" ") for k, t in enumerate(lowered)]
        self._learn(set().union(*parts))
        ids, sizes = self.words.take(np.fromiter(map(self.words.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts))))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(words) for words in parts])]
        encoded = np.split(ids, ends[:-1])
        for k in whole:
            encoded[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return encoded


@cache
def encoder_of(path: str) -> WordTokens:
    """The encoder of a Python worker, which its tasks share."""
    return WordTokens(path)


def pieces(rows: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: each document's ids, then end_id, cut into pieces that cover them."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = encoder_of(tokenizer)
        for batch, texts in text_blocks(batches, "text", 1 << 20):
            out = {"at": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for k, ids in enumerate(encoder.encode(texts)):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for size in cut(len(raw), capacity):
                    for name, value in zip(out, (k, at, size, zlib.crc32(raw[at:at + size].data), len(raw)), strict=True):
                        out[name].append(value)
                    at += size
            yield {"doc": batch["doc"].take(out.pop("at"))} | out

    chosen = rows.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return in_arrow(chosen, work, "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _close_open(capacity: int):
    def run(open_pieces: pd.DataFrame) -> pd.DataFrame:
        """First fit, largest first, over the pieces of open sequences."""
        ordered = open_pieces.sort_values(["length", "doc", "start", "ids_crc32"], ascending=[False, True, True, True])
        free = np.zeros(len(ordered), np.int64)
        used = 0
        own, at = [], []
        for length in ordered["length"]:
            fits = np.flatnonzero(free[:used] >= length)
            if len(fits):
                k = int(fits[0])
            else:
                k, free[used], used = used, capacity, used + 1
            own.append(k)
            at.append(capacity - free[k])
            free[k] -= length
        return ordered.assign(sequence_id=ordered["base"] + own, offset=at)[["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(rows: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row given.

    A null text counts as empty: its only id is end_id. Rows repeated, or without a key, are packed like any other. No
    row in, no row out. Other columns are ignored. `tokenizer` is the path of a tokenizer file on every machine.
    """
    cut_up = settle(pieces(rows, tokenizer, key, text, end_id, capacity))
    count = cut_up.count()
    chunks = max(1, count // CHUNK_PIECES)
    cut_up = cut_up.withColumn("class", F.expr(f"{capacity} div length")).withColumn("chunk", F.pmod(F.xxhash64("doc", "start"), F.lit(chunks)))
    counts = cut_up.groupBy("class", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts)
    # one row for each class and chunk here, one for each class (at most `capacity`) there
    before = counts.select("class", "chunk", (F.sum("n").over(Window.partitionBy("class").orderBy("chunk")) - F.col("n")).alias("before"))
    classes = counts.groupBy("class").agg(F.sum("n").alias("n")).withColumn("bins", F.expr("n div class"))
    classes = classes.withColumn("base", F.sum("bins").over(Window.orderBy("class")) - F.col("bins"))
    full = classes.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
    numbered = (cut_up.withColumn("rank", F.row_number().over(Window.partitionBy("class", "chunk").orderBy("doc", "start", "ids_crc32")) - 1)
                .join(before, ["class", "chunk"]).join(F.broadcast(classes.select("class", "bins", "base")), "class")
                .withColumn("number", F.col("before") + F.col("rank")).withColumn("bin", F.expr("number div class")))
    numbered = settle(numbered.select("doc", "start", "length", "ids_crc32", "doc_tokens", "number", (F.col("bin") < F.col("bins")).alias("whole"),
                                      (F.col("base") + F.col("bin")).alias("sequence_id")))
    whole = numbered.where("whole").withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("number")) - F.col("length"))
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = numbered.where("NOT whole").withColumn("base", F.lit(full).cast("bigint"))
    closed = rest.groupBy("base").applyInPandas(
        _close_open(capacity), "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return whole.select(*names).unionByName(closed.select(*names)).withColumnRenamed("doc", key)
