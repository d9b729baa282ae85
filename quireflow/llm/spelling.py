"""Spelling variants: words that differ by one letter, found through a bit-sliced index of letters by position.

The index of a block of words has one bitset for each position and letter: which words have that letter there. For a
query word two kinds of sets run along its letters: the words without an error so far, and those with one (a letter
replaced, missing or added, the last two compared one position back or ahead). Each step is a few operations on whole
machine words, for all words of the block and all query words at once.

Blocks are made so that near words meet in one: a word is cut into parts, and one error leaves all parts but one as they
are. Words are grouped by what is outside of one part, once for each part, for the length of the word and for that of
words one letter shorter. A part has two letters in words of up to 32, so a group is bounded by the alphabet. A pair is
taken only in the group of the part that its first difference falls in, so it is counted once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import in_arrow, text_blocks
from quireflow.session import release, settle

LEAST_LETTERS, LEAST_COUNT, TIMES_MORE = 6, 5, 5
PART, MOST_PARTS = 2, 16
BLOCK, BLOCK_CHARS = 1024, 1 << 20
_COUNTED = 400_000


def damaged(key: object, word: str, every: int) -> str:
    """The word without one of its letters, if the hash of key and word is divisible by `every`; else as it is."""
    chance = zlib.crc32(word.encode(), zlib.crc32(b"%s:" % str("" if key is None else key).encode()))
    if chance % every:
        return word
    at = chance % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(rows: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, every: int = 199) -> DataFrame:
    """word, n: runs of Latin letters of at least so many letters and occurrences, A-Z lower-cased, damaged() by key.

    Counts are summed in each task before they are shuffled.
    """
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % letters)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter[str] = Counter()
        for batch, texts in text_blocks(batches, "text"):
            for name, raw in zip(batch["key"].to_pylist(), texts, strict=True):
                # bytes.lower() changes A-Z alone
                seen = Counter(pattern.findall(raw.lower().decode())) if raw else {}
                start = zlib.crc32(b"%s:" % (name or "").encode())
                for word, n in seen.items():
                    if zlib.crc32(word.encode(), start) % every:
                        counts[word] += n
                    else:
                        counts[damaged(name, word, every)] += n
            if len(counts) > _COUNTED:
                yield {"word": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    chosen = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    found = in_arrow(chosen, work, "word string, n bigint").where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class PositionIndex:
    """Which words of a block have which letter at which position, as bitsets of 64 words a lane."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, alphabet: int):
        """`letters` has a row for each word: numbers from 1 to alphabet - 1, 0 behind its end."""
        self.words, self.positions = letters.shape
        self.lanes = -(-self.words // 64)
        self.letters, self.lengths, self.alphabet = letters, lengths, alphabet
        self.none = np.zeros((alphabet, self.lanes), np.uint64)

    def bits(self, chosen: np.ndarray) -> np.ndarray:
        """Rows of booleans over the words as rows of lanes."""
        padded = np.zeros((*chosen.shape[:-1], self.lanes * 64), bool)
        padded[..., :self.words] = chosen
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """The bitset of each letter at a position."""
        if not 0 <= position < self.positions:
            return self.none
        sets = self.bits(self.letters[:, position] == np.arange(self.alphabet)[:, None])
        sets[0] = 0
        return sets

    def of_length(self, length: int) -> np.ndarray:
        return self.bits((self.lengths == length)[None])[0]

    def near(self, queries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that differ by exactly one letter; all queries have the given length."""
        exact = np.broadcast_to(self.bits(np.ones((1, self.words), bool)), (len(queries), self.lanes))
        replaced = added = missing = np.zeros((len(queries), self.lanes), np.uint64)
        back, here, ahead = self.none, self.at(0), self.at(1)
        for k in range(length):
            letter = queries[:, k]
            same = here[letter]
            replaced = replaced & same | exact & ~same
            added = (added | exact) & ahead[letter]  # the word has a letter more: it is compared one ahead
            missing = missing & back[letter] | exact  # a letter less: one back
            exact = exact & same
            back, here, ahead = here, ahead, self.at(k + 2)
        found = replaced & self.of_length(length) | (added | exact) & self.of_length(length + 1) | missing & self.of_length(length - 1)
        query, lane = np.nonzero(found)
        bit = np.unpackbits(found[query, lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, place = np.nonzero(bit)
        return query[hit], lane[hit] * 64 + place


def keys(words: DataFrame) -> DataFrame:
    """word, n, size, part, key: the groups of a word. size is the shorter length of the pairs to be found there."""
    length = F.length("word")
    parts = f"least({MOST_PARTS}, (size + {PART - 1}) div {PART})"
    cut = (words.withColumn("size", F.explode(F.array(length, length - 1))).where(F.col("size") > 0)
           .withColumn("parts", F.expr(parts)).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
           .withColumn("start", F.expr("part * size div parts")).withColumn("end", F.expr("(part + 1) * size div parts")))
    return cut.select("word", "n", "size", "part", F.xxhash64(
        "size", "part", F.expr("substr(word, 1, start)"), F.expr("right(word, size - end)")).alias("key"))


def _part_of(place: np.ndarray, size: int) -> np.ndarray:
    """The part that a place of a word of `size` letters falls in."""
    parts = min(MOST_PARTS, -(-size // PART))
    ends = np.arange(1, parts + 1) * size // parts
    return np.searchsorted(ends, np.minimum(place, size - 1), side="right")


def _near_in(words: list[str], size: int, part: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (both ways) of one group whose words are near and first differ in the group's part."""
    text = np.array(words, f"<U{size + 1}").view(np.uint32).reshape(len(words), size + 1)
    alphabet, letters = np.unique(np.append(text.ravel(), 0), return_inverse=True)
    letters = letters[:-1].reshape(text.shape)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    left, right = [], []
    for low in range(0, len(words), BLOCK):
        high = min(low + BLOCK, len(words))
        index = PositionIndex(letters[low:high], lengths[low:high], len(alphabet))
        # a block takes whole groups unless one group is larger; then its other rows are queries of this block too
        asked = np.flatnonzero((group >= group[low]) & (group <= group[high - 1]))
        for step in range(0, len(asked), BLOCK):
            some = asked[step:step + BLOCK]
            for length in (size, size + 1):
                rows = some[lengths[some] == length]
                if not len(rows):
                    continue
                query, word = index.near(letters[rows], length)
                query, word = rows[query], word + low
                fits = (group[query] == group[word]) & (np.minimum(lengths[query], lengths[word]) == size)
                query, word = query[fits], word[fits]
                first = np.argmax(letters[query] != letters[word], axis=1)
                fits = _part_of(first, size) == part[query]
                left.append(query[fits])
                right.append(word[fits])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each pair of different words of `words` (word, n) that differ by one letter, both ways, once."""
    def blocks(batches: Iterator[dict]) -> Iterator[tuple[int, dict]]:
        """Rows of one size, in whole groups, about BLOCK rows or BLOCK_CHARS letters; groups of one row are left out."""
        held: dict | None = None
        for batch in batches:
            new = {n: c.to_numpy(zero_copy_only=False) for n, c in batch.items()}
            held = new if held is None else {n: np.concatenate((held[n], new[n])) for n in new}
            if len(held["key"]) < BLOCK:
                continue
            starts = _starts(held)
            yield from _cut({n: c[:starts[-1]] for n, c in held.items()})
            held = {n: c[starts[-1]:] for n, c in held.items()}
        if held is not None:
            yield from _cut(held)

    def _starts(rows: dict) -> np.ndarray:
        changed = (rows["key"][1:] != rows["key"][:-1]) | (rows["size"][1:] != rows["size"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
        return np.flatnonzero(np.append(True, changed)) if len(rows["key"]) else np.zeros(0, np.int64)

    def _cut(rows: dict) -> Iterator[tuple[int, dict]]:
        starts = _starts(rows)
        if not len(starts):
            return
        counts = np.diff(np.append(starts, len(rows["key"])))
        alone = np.repeat(counts == 1, counts)
        group = np.repeat(np.arange(len(starts)), counts)
        rows = {n: c[~alone] for n, c in rows.items()} | {"group": group[~alone]}
        if alone.all():
            return
        starts = np.flatnonzero(np.append(True, np.diff(rows["group"]) != 0))
        ends = np.append(starts[1:], len(rows["group"]))
        low = 0
        for k, end in enumerate(ends):
            size = rows["size"][low]
            following = k + 1 < len(ends)
            if not following or rows["size"][end] != size or ends[k + 1] - low > BLOCK or (ends[k + 1] - low) * size > BLOCK_CHARS:
                yield int(size), {n: c[low:end] for n, c in rows.items()}
                low = end

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for size, rows in blocks(batches):
            words = rows["word"].tolist()
            left, right = _near_in(words, size, rows["part"], rows["group"])
            if len(left):
                yield {"word": pa.array(words).take(pa.array(left)), "near": pa.array(words).take(pa.array(right)), "near_n": rows["n"][right]}

    placed = keys(words).repartition("size", "key").sortWithinPartitions("size", "key", "part")
    return in_arrow(placed, work, "word string, near string, near_n bigint")


def variants(rows: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT,
             times: int = TIMES_MORE, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of vocabulary().

    form is the near word that occurs most (ties: the first in code-point order), if it does `times` as often or more;
    else null. root is where following forms ends, the word itself if it has none: each step is `times` as frequent, so
    the way is short and never leads back. A null or empty text has no word; a row without a key is damaged as if its
    key were the empty string; repeated rows count again; no row gives no word. Other columns are ignored.
    """
    words = settle(vocabulary(rows, key, text, letters, count, every))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = (F.col("best")["less"] * -1 >= F.col("n") * times)
    formed = settle(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best")["near"]).alias("form"), F.when(taken, -F.col("best")["less"]).alias("form_n")))
    release(words)
    # jumps double, so a way of k forms takes log2(k) rounds
    upward = settle(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        above = upward.select(F.col("word").alias("root"), F.col("root").alias("top"))
        longer = settle(upward.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        release(upward)
        upward = longer
        if not longer.where("moved").limit(1).count():
            break
    return formed.join(upward.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
