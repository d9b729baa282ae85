"""Best-fit-decreasing packing of tokenised documents, each whole where it fits a sequence.

Pieces are placed from the longest to the shortest, each in the open bin with the least room that still takes it. Only
the room of a bin matters, so a segment tree counts the open bins of each room, 0 to the capacity, and finds the
tightest in logarithmic time. Pieces of one length are taken together: they fill the tightest bin until it takes no more
of them, then the next, exactly as one after the other would. What the tree works on is therefore the number of
pieces of each length, a table whose size the capacity bounds, and what it gives is a list of runs of bins. The pieces
themselves stay on the executors: a piece's number among those of its length gives its bin and its place there.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quireflow.functions.scan import running
from quireflow.llm.common import in_arrow, text_blocks
from quireflow.llm.packing import encoder_of
from quireflow.session import settle

CAPACITY = 2048
CHUNK_PIECES, CHUNKS_TOGETHER = 2048, 4096


class Rooms:
    """Segment tree over rooms: how many open bins have each room, and which."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        # runs of bins with consecutive numbers, by room
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _count(self, room: int, change: int) -> None:
        at = self.size + room
        while at:
            self.open[at] += change
            at >>= 1

    def add(self, room: int, first: int, bins: int) -> None:
        if bins:
            self.runs[room].append((first, bins))
            self._count(room, bins)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """The first run of bins of this room, cut to `most` of them."""
        first, bins = self.runs[room].popleft()
        if bins > most:
            self.runs[room].appendleft((first + most, bins - most))
        self._count(room, -min(bins, most))
        return first, min(bins, most)

    def tightest(self, length: int) -> int | None:
        """The smallest room of `length` or more that an open bin has."""
        at = self.size + length
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Pieces of one length, from number `piece` on, `each` to a bin from `bin` on, the first at `offset` in it."""

    length: int
    piece: int
    bin: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Where best-fit decreasing puts so many pieces of each length, and how many bins it opens."""
    rooms, runs, bins = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # nothing takes a piece: as many new bins as the rest fills
                room = capacity
                each = room // length
                opened = -(-left // each)
                rooms.add(room, bins, opened)
                bins += opened
            each = room // length
            # whole bins first; what then is left goes to one more
            first, taken = rooms.take(room, left // each or 1)
            fill = min(each, left)
            runs.append(Run(length, placed, first, fill, capacity - room))
            rooms.add(room - fill * length, first, taken)
            placed, left = placed + fill * taken, left - fill * taken
    return runs, bins


def pieces(rows: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, salt: each document's ids, then end_id; only longer ones are cut.

    The salt is a piece's number in its task, so that equal rows don't stay together.
    """
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        encoder, salt = encoder_of(tokenizer), 0
        for batch, texts in text_blocks(batches, "text", 1 << 20):
            out = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for k, ids in enumerate(encoder.encode(texts)):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                for number, start in enumerate(range(0, len(raw), capacity)):
                    part = raw[start:start + capacity]
                    for name, value in zip(out, (k, number, start, len(part), zlib.crc32(part.data)), strict=True):
                        out[name].append(value)
            salts = np.arange(salt, salt + len(out["at"]))
            salt += len(salts)
            yield {"doc": batch["doc"].take(out.pop("at")), "salt": salts} | out

    chosen = rows.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return in_arrow(chosen, work, "doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint")


def pack(rows: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row given.

    A null text counts as empty: its only id is end_id. Rows repeated, or without a key, are packed like any other. Of
    pieces of one length any may stand for another, so ties have no say in the number of sequences. No row in, no row
    out. Other columns are ignored. `tokenizer` is the path of a tokenizer file on every machine.
    """
    cut_up = settle(pieces(rows, tokenizer, key, text, end_id, capacity))
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    chunks = F.broadcast(rows.sparkSession.createDataFrame([(k, 1 + n // CHUNK_PIECES) for k, n in counts.items()], "length bigint, chunks bigint"))
    dealt = cut_up.join(chunks, "length").withColumn("chunk", F.pmod(F.xxhash64("doc", "start", "salt"), F.col("chunks"))).drop("chunks")
    sizes = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.expr(f"chunk div {CHUNKS_TOGETHER}"))
    before = running(sizes, ["length"], ["part"], ["chunk"], sums={"upto": F.col("n")}).select("length", "chunk", (F.col("upto") - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc", "start", "ids_crc32", "salt")) - 1)
    numbered = ranked.join(before, ["length", "chunk"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("number"))
    found = in_arrow(numbered, _places(runs), "doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return found.withColumnRenamed("doc", key)


def _places(runs: list[Run]):
    """Sequence and offset of numbered pieces. The runs' number is bounded by the capacity, not by the pieces."""
    runs = sorted(runs, key=lambda r: (r.length, r.piece))
    lengths, firsts, bins, each, offsets = (np.array([getattr(r, name) for r in runs], np.int64) for name in ("length", "piece", "bin", "each", "offset"))
    longest = int(lengths.max()) if len(runs) else 0
    begins = np.searchsorted(lengths, np.arange(longest + 2))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            length, number = (batch[name].to_numpy(zero_copy_only=False) for name in ("length", "number"))
            at = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                low, high = begins[length[same[0]]], begins[length[same[0]] + 1]
                at[same] = low + np.searchsorted(firsts[low:high], number[same], side="right") - 1
            past = number - firsts[at]
            yield {name: batch[name] for name in ("doc", "piece", "start", "length", "ids_crc32")} | {
                "sequence_id": bins[at] + past // each[at], "offset": offsets[at] + past % each[at] * length}

    return work
