"""SimHash near-dedup by a generalised pigeonhole.

The bits of a fingerprint are grouped into partitions so that correlated bits stand together. Fingerprints that differ
in at most d bits differ in at most t_i bits in some partition i whenever the sum of all (t_i + 1) is d + 1. A dynamic
program gives each partition its own t_i (-1: not probed) for the least cost, from candidate counts estimated on a
bounded sample. Every fingerprint is indexed by its bits in each partition and probes all values within t_i of them;
what meets is verified on all bits. Only a forest of the links found leaves a task, so a group of n near copies costs
n - 1 links and not n squared, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.functions.graph import components
from quireflow.llm.common import in_arrow, text_blocks
from quireflow.llm.digest_index import only_these, plain_key
from quireflow.session import release, settle

SEED = 42
SAMPLE = 20_000
CHUNK = 4096
PROBE_COST = 150.0
LINKS = 2_000_000
COMMON_SAMPLE, COMMON = 2000, 4
BROADCAST = 500_000
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
_PAIRS = 1 << 21
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of `width` words, repeats included; of all words if there are fewer; none without a word.

    A-Z are lower-cased; words are what stands between blanks and the characters 9 to 13.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:len(words) - width])).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (stops[width - 1:] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without a hash."""
    full = -len(hashes) % 255
    lanes = np.concatenate((hashes, np.zeros(full, np.uint64))).reshape(-1, 255)
    counts = np.zeros((8, 8), np.int64)  # by bit of a byte, then by byte
    for bit in range(8):
        # eight bytes are summed side by side; 255 ones fit a byte
        sums = ((lanes >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    ones = counts.T.reshape(-1) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, width: int, key: str = "doc_id", text: str = "text", more: bool = False) -> DataFrame:
    """doc, text_hash, fp (64 bits as a bigint) and, with `more`, fp2: 64 further bits from other hashes of the shingles."""
    spread = np.uint64(0x9E3779B97F4A7C15)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, texts in text_blocks(batches, "text"):
            first, second = [], []
            for t in texts:
                hashes = shingle_hashes(t, width)
                first.append(majority(hashes))
                if more:
                    mixed = (hashes ^ (hashes >> np.uint64(32))) * spread
                    second.append(majority((mixed ^ (mixed >> np.uint64(29))) * spread))
            out = {"doc": batch["doc"], "text_hash": batch["text_hash"], "fp": np.array(first, np.uint64).view(np.int64)}
            yield out | ({"fp2": np.array(second, np.uint64).view(np.int64)} if more else {})

    whole = F.coalesce(F.col(text), F.lit(""))
    chosen = rows.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    return in_arrow(chosen, work, "doc bigint, text_hash bigint, fp bigint" + ", fp2 bigint" * more)


@dataclass(frozen=True)
class Plan:
    """Masks of the partitions and how many differing bits each is probed with."""

    masks: tuple[int, ...]
    radii: tuple[int, ...]

    def flips(self) -> list[tuple[int, int, int]]:
        """(partition, mask, bits to flip) of every probe; 0 for the value itself comes first."""
        out = []
        for part, (mask, radius) in enumerate(zip(self.masks, self.radii, strict=True)):
            bits = [1 << b for b in range(64) if mask >> b & 1]
            for r in range(radius + 1):
                out += [(part, mask, sum(some)) for some in combinations(bits, r)]
        return out


def _grouped(together: np.ndarray, parts: int) -> list[int]:
    """Masks of `parts` groups of bits, nearly equal in size: each grows by the bit most correlated with it."""
    left = set(range(64))
    masks = []
    for part in range(parts):
        size = 64 // parts + (part < 64 % parts)
        own: list[int] = []
        while len(own) < size:
            weigh = (lambda b: together[b, own].sum()) if own else (lambda b: together[b, list(left)].sum())
            own.append(max(sorted(left), key=weigh))
            left.discard(own[-1])
        masks.append(sum(1 << b for b in own))
    return masks


def _allocated(cost: list[list[float]], budget: int) -> tuple[float, tuple[int, ...]]:
    """Radii of least total cost with sum of (radius + 1) equal to the budget; cost[i][r + 1] is for radius r."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in cost:
        grown: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (total, radii) in best.items():
            for step, price in enumerate(own):
                if spent + step <= budget and (spent + step not in grown or total + price < grown[spent + step][0]):
                    grown[spent + step] = (total + price, (*radii, step - 1))
        best = grown
    return best.get(budget, (float("inf"), ()))


def plan_probes(sample: np.ndarray, rows: int, bits: int) -> Plan:
    """Partitions and radii for `rows` fingerprints, of which `sample` is some, and links of at most `bits` bits.

    A probe costs what about PROBE_COST comparisons do: it is shuffled and sorted.
    """
    spread = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    spread -= spread.mean(axis=0) if len(spread) else 0
    size = np.sqrt((spread ** 2).sum(axis=0))
    together = np.abs(spread.T @ spread) / np.maximum(np.outer(size, size), 1e-9)
    np.fill_diagonal(together, 0)
    asks = sample[:500]
    choices = []
    for parts in range(1, bits + 2):
        masks, cost = _grouped(together, parts), []
        for mask in masks:
            apart = np.bitwise_count((asks[:, None] ^ sample[None, :]) & np.uint64(mask))
            near = np.bincount(apart.ravel(), minlength=65).cumsum() - len(asks)  # without itself
            width = mask.bit_count()
            own, probes = [0.0], 0
            for radius in range(min(width, bits) + 1):
                probes += comb(width, radius)
                if probes > 1000:
                    break
                share = max(near[radius] / max(asks.size * max(sample.size - 1, 1), 1), probes / 2.0 ** width)
                own.append(rows * probes * PROBE_COST + share * rows * rows)
            cost.append(own)
        total, radii = _allocated(cost, bits + 1)
        choices.append((total, tuple(masks), radii))
    _, masks, radii = min(choices, key=lambda c: c[0])
    used = [(m, r) for m, r in zip(masks, radii, strict=True) if r >= 0]
    return Plan(tuple(m for m, _ in used), tuple(r for _, r in used))


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of links that connect all that the links (a, b) connect, without a cycle, the lightest first.

    Of equally light links the one with the smaller ends goes first, so that forests of overlapping sets agree.
    """
    turn = np.lexsort((b, a, weight))
    _, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(ends.max() + 1 if len(ends) else 0)
    a, b = a[turn], b[turn]
    chosen = np.zeros(len(a), bool)
    open_ = np.flatnonzero(label[a] != label[b])
    while len(open_):
        la, lb = label[a[open_]], label[b[open_]]
        first = np.full(len(label), len(a))
        np.minimum.at(first, la, open_)
        np.minimum.at(first, lb, open_)
        picked = np.unique(first[first < len(a)])
        chosen[picked] = True
        la, lb = label[a[picked]], label[b[picked]]
        while True:  # smallest label over the picked links
            low = np.minimum(label[la], label[lb])
            before = label.copy()
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            label = label[label]
            if (label == before).all():
                break
        open_ = open_[label[a[open_]] != label[b[open_]]]
    return turn[chosen]


def _meet(bits: int, bits_of_128: int | None):
    """Work on rows sorted by (part, key, chunk, probe): links of at most `bits` bits between index rows and the rows of their group.

    With bits_of_128, rows have fp2 as well, and a link at most so many differing bits in both together.
    """
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        held_group, held, held2 = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            fp2 = batch["fp2"].to_numpy(zero_copy_only=False).view(np.uint64) if bits_of_128 is not None else fp
            probe = batch["probe"].to_numpy(zero_copy_only=False)
            group = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "chunk")], axis=1)
            carried = len(held) if held_group is not None and (group[0] == held_group).all() else 0
            if carried:
                fp, fp2, probe = np.concatenate((held, fp)), np.concatenate((held2, fp2)), np.concatenate((np.zeros(carried, bool), probe))
                group = np.concatenate((np.repeat(group[:1], carried, axis=0), group))
            heads = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1))))
            sizes = np.diff(np.append(heads, len(fp)))
            start = np.repeat(heads, sizes)
            indexed = np.repeat(np.add.reduceat((~probe).astype(np.int64), heads), sizes)
            # an index row meets those before it, a probe all index rows of its group; carried rows have met already
            meets = np.minimum(np.arange(len(fp)) - start, indexed)
            meets[:carried] = 0
            ends = np.cumsum(meets)
            row = 0
            while row < len(fp):
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + _PAIRS)))
                count = meets[row:stop]
                left = np.repeat(np.arange(row, stop), count)
                right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + start[left]
                apart = np.bitwise_count(fp[left] ^ fp[right])
                hit = np.flatnonzero((apart <= bits) & (fp[left] != fp[right]))
                weight = apart[hit].astype(np.int64)
                if bits_of_128 is not None:
                    weight += np.bitwise_count(fp2[left[hit]] ^ fp2[right[hit]])
                    hit, weight = hit[weight <= bits_of_128], weight[weight <= bits_of_128]
                if len(hit):
                    a, b = fp[left[hit]].view(np.int64), fp[right[hit]].view(np.int64)
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    tree = forest(a, b, weight)
                    yield {"a": a[tree], "b": b[tree]}
                row = stop
            last = heads[-1]
            held_group, held, held2 = group[-1].copy(), fp[last:][~probe[last:]], fp2[last:][~probe[last:]]

    return work


def _thinned(batches: Iterator[dict]) -> Iterator[dict]:
    """A forest of all links of a partition, of which there are about LINKS."""
    ends = [[batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b")] for batch in batches]
    if ends:
        a, b = (np.concatenate(own) for own in zip(*ends, strict=True))
        tree = forest(a, b, np.zeros(len(a), np.int64))
        yield {"a": a[tree], "b": b[tree]}


def link(prints: DataFrame, bits: int, bits_of_128: int | None = None, sample_rows: int = SAMPLE) -> DataFrame:
    """a, b: links between the distinct values of fp in `prints` that connect all values at most `bits` bits apart.

    With bits_of_128, `prints` has fp2 as well, and linked values differ in at most so many bits of both together.

    The plan is fitted on about sample_rows values, those of the smallest hashes; all values are indexed and probed. A
    value of a partition that more than CHUNK fingerprints share is split: each chunk is a group of its own, which the
    others probe.
    """
    more = [] if bits_of_128 is None else ["fp2"]
    values = settle(prints.groupBy("fp").agg(F.max("fp2").alias("fp2")) if more else prints.select("fp").distinct())
    rows = values.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = values.where(F.pmod(F.xxhash64(F.col("fp"), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()["fp"]
    plan = plan_probes(sample.to_numpy(np.int64).view(np.uint64), rows, bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flips = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(signed(m)).cast("bigint").alias("mask"), F.lit(signed(x)).cast("bigint").alias("flip"))
                      for p, m, x in plan.flips()])
    masks = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(signed(m)).cast("bigint").alias("mask")) for p, m in enumerate(plan.masks)])
    heavy = (values.select("fp", F.explode(masks).alias("m")).groupBy("m.part", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    heavy = settle(heavy.select("part", "key", "chunks"))
    probes = values.select("fp", *more, F.explode(flips).alias("f")).select(
        "fp", *more, "f.part", F.col("fp").bitwiseAND(F.col("f.mask")).bitwiseXOR(F.col("f.flip")).alias("key"), (F.col("f.flip") != 0).alias("probe"))
    count = heavy.count()
    if not count:
        dealt = probes.withColumn("chunk", F.lit(0))
    else:
        # at most parts x rows / CHUNK values are heavy; sent to all tasks only while they are few
        marked = probes.join(F.broadcast(heavy) if count <= 100_000 else heavy, ["part", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        everywhere = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("probe")))
        others = F.filter(everywhere, lambda c: F.col("probe") | (c["chunk"] != own))
        home = F.array(F.struct(own.alias("chunk"), F.lit(False).alias("probe")))
        places = (F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("chunk"), F.col("probe").alias("probe"))))
                  .when(F.col("probe"), others).otherwise(F.concat(home, others)))
        dealt = marked.select("fp", *more, "part", "key", F.explode(places).alias("p")).select("fp", *more, "part", "key", "p.chunk", "p.probe")
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * len(plan.flips()) // 4_000_000)
    met = dealt.repartition(tasks, "part", "key", "chunk").sortWithinPartitions("part", "key", "chunk", "probe")
    found = settle(in_arrow(met.select("part", "key", "chunk", "probe", "fp", *more), _meet(bits, bits_of_128), "a bigint, b bigint").distinct())
    # the tasks' forests overlap; any part of their links can be thinned to a forest of its own
    parts = max(1, found.count() // LINKS)
    return in_arrow(found.repartition(parts), _thinned, "a bigint, b bigint")


def classes(prints: DataFrame, links: DataFrame) -> DataFrame:
    """fp, component_id: for each value of fp the smallest doc in its class."""
    values = prints.groupBy("fp").agg(F.min("doc").alias("first"))
    links = settle(links)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    grouped = components(ends, links, []).withColumnRenamed("node", "fp")
    values = settle(values.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = values.groupBy("component").agg(F.min("first").alias("component_id"))
    return values.join(smallest, "component").select("fp", "component_id")


def near_duplicates(rows: DataFrame, width: int = 4, bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component_id: one row for each row given, with the smallest key of the rows linked to it, itself included.

    Rows are linked if their fingerprints differ in at most `bits` bits, and so are chains of links. A null or empty
    text, or one of white space, has the fingerprint 0 and is linked like any other. Rows without a key are linked but
    never name a class; a class of them alone has a null component_id. Repeated rows give repeated results. No row in,
    no row out. Columns other than the two named are ignored. Texts are read whole.
    """
    prints = settle(fingerprints(rows, width, key, text))
    found = settle(classes(prints, link(prints, bits)))
    return prints.join(found, "fp").select(F.col("doc").alias(key), "fp", "component_id")


def _ordered(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles in one order for all texts, those of `common` (sorted) last by their counts, and how many are not in it."""
    if not len(common):
        return shingles, len(shingles)
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    count = np.where(common[at] == shingles, counts[at], 0)
    turn = np.lexsort((shingles, count))
    return shingles[turn], int((count == 0).sum())


def shingle_sets(rows: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """key, shingles: the distinct shingles of each text in ascending order."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, texts in text_blocks(batches, "text"):
            yield {"key": batch["key"], "shingles": [np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts]}

    return in_arrow(rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), work, "key bigint, shingles array<bigint>")


def _common(rows: DataFrame, width: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that COMMON of about COMMON_SAMPLE texts have, and in how many. They only set the order of shingles."""
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("common"))
    share = min(1.0, COMMON_SAMPLE / max(rows.count(), 1))
    some = rows.where(F.pmod(whole, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("__key", whole).select("__key", text)
    found = (shingle_sets(some, width, "__key", text).select(F.explode("shingles").alias("shingle")).groupBy("shingle")
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).toPandas())
    shingles = found["shingle"].to_numpy(np.int64).view(np.uint64)
    turn = np.argsort(shingles)
    return shingles[turn], found["n"].to_numpy(np.int64)[turn]


def heads(rows: DataFrame, width: int, alike: float, key: str, text: str) -> DataFrame:
    """doc, text_hash, fp, fp2 (128 bits of the distinct shingles), size (their number), head and rare.

    Of two texts with a Jaccard similarity of `alike` or more each has a share `alike` of its shingles in the other, so
    that in any one order of shingles they meet in the first n - ceil(alike n) + 1 of their n: the head. The first
    `rare` of it are not among the common shingles. A text without a word has the head 0.
    """
    spread = np.uint64(0x9E3779B97F4A7C15)
    common, counts = _common(rows, width, text)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, texts in text_blocks(batches, "text"):
            out = {n: [] for n in ("fp", "fp2", "size", "head", "rare")}
            for t in texts:
                own = np.unique(shingle_hashes(t, width))
                mixed = (own ^ (own >> np.uint64(32))) * spread
                out["fp"].append(majority(own))
                out["fp2"].append(majority((mixed ^ (mixed >> np.uint64(29))) * spread))
                turned, rare = _ordered(own, common, counts)
                n = len(own) - ceil(alike * len(own) - 1e-9) + 1
                out["size"].append(len(own))
                out["head"].append(turned[:n].view(np.int64) if len(own) else np.zeros(1, np.int64))
                out["rare"].append(rare)
            fps = {n: np.array(out[n], np.uint64).view(np.int64) for n in ("fp", "fp2")}
            yield {"doc": batch["doc"], "text_hash": batch["text_hash"]} | out | fps

    whole = F.coalesce(F.col(text), F.lit(""))
    chosen = rows.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    return in_arrow(chosen, work, "doc bigint, text_hash bigint, fp bigint, fp2 bigint, size int, head array<bigint>, rare int")


def _meet_heads(bits_of_128: int):
    """Work on rows sorted by (key, chunk, probe): a forest of the pairs of a group that differ in at most bits_of_128 bits."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        held, held_group = None, None
        for batch in batches:
            node, fp, fp2 = (batch[c].to_numpy(zero_copy_only=False) for c in ("node", "fp", "fp2"))
            fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)
            probe = batch["probe"].to_numpy(zero_copy_only=False)
            group = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "chunk")], axis=1)
            carried = len(held[0]) if held is not None and (group[0] == held_group).all() else 0
            if carried:
                node, fp, fp2 = (np.concatenate(two) for two in zip(held, (node, fp, fp2), strict=True))
                probe = np.concatenate((np.zeros(carried, bool), probe))
                group = np.concatenate((np.repeat(group[:1], carried, axis=0), group))
            first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1))))
            sizes = np.diff(np.append(first, len(fp)))
            start = np.repeat(first, sizes)
            indexed = np.repeat(np.add.reduceat((~probe).astype(np.int64), first), sizes)
            # an index row meets those before it, a probe all index rows of its group; carried rows have met already
            meets = np.minimum(np.arange(len(fp)) - start, indexed)
            meets[:carried] = 0
            ends = np.cumsum(meets)
            row = 0
            while row < len(fp):
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + _PAIRS)))
                count = meets[row:stop]
                left = np.repeat(np.arange(row, stop), count)
                right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + start[left]
                apart = np.bitwise_count(fp[left] ^ fp[right]).astype(np.int64) + np.bitwise_count(fp2[left] ^ fp2[right])
                hit = np.flatnonzero((apart <= bits_of_128) & (node[left] != node[right]))
                if len(hit):
                    a, b = node[left[hit]], node[right[hit]]
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    tree = forest(a, b, apart[hit])
                    yield {"a": a[tree], "b": b[tree], "weight": apart[hit][tree]}
                row = stop
            last = first[-1]
            index = ~probe[last:]
            held_group, held = group[-1].copy(), (node[last:][index], fp[last:][index], fp2[last:][index])

    return work


def _thinned_by_weight(batches: Iterator[dict]) -> Iterator[dict]:
    """A forest of all links of a partition, of which there are about LINKS."""
    ends = [[batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "weight")] for batch in batches]
    if ends:
        a, b, weight = (np.concatenate(own) for own in zip(*ends, strict=True))
        tree = forest(a, b, weight)
        yield {"a": a[tree], "b": b[tree]}


def head_links(nodes: DataFrame, bits_of_128: int) -> DataFrame:
    """a, b: links that connect all nodes (node, fp, fp2, head, rare) which share a shingle of their heads and are near.

    A shingle that more than CHUNK heads have is split: each chunk is a group of its own, which the others probe. Only
    common shingles are counted for that; with another, COMMON / COMMON_SAMPLE of the texts would rarely go unseen.
    """
    each = nodes.select("node", "fp", "fp2", "rare", F.posexplode("head").alias("at", "key"))
    counted = each.where((F.col("at") >= F.col("rare")) | (F.col("key") == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = settle(counted.where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    each = each.select("key", "node", "fp", "fp2")
    count = heavy.count()
    if not count:
        dealt = each.withColumns({"chunk": F.lit(0), "probe": F.lit(False)})
    else:
        marked = each.join(F.broadcast(heavy) if count <= 100_000 else heavy, "key", "left")
        own = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
        places = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda c: F.struct(c.alias("chunk"), (c != own).alias("probe")))
        dealt = marked.select("key", "node", "fp", "fp2", F.explode(places).alias("p")).select("key", "node", "fp", "fp2", "p.chunk", "p.probe")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(tasks, "key", "chunk").sortWithinPartitions("key", "chunk", "probe")
    found = settle(in_arrow(met, _meet_heads(bits_of_128), "a bigint, b bigint, weight bigint").distinct())
    parts = max(1, found.count() // LINKS)
    return in_arrow(found.repartition(parts), _thinned_by_weight, "a bigint, b bigint")


def alike_pairs(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """a, b, alike: whether the sets (key, shingles) of these keys have a Jaccard similarity of `alike` or more."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= alike * (len(x) + len(y) - both) - 1e-9)
            yield {"a": batch["a"], "b": batch["b"], "alike": good}

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return in_arrow(both.select("a", "b", "x", "y"), work, "a bigint, b bigint, alike boolean")


def _as_stars(batches: Iterator[dict]) -> Iterator[dict]:
    """Links from the smallest node to each other one of the components of a partition's links, of which there are about LINKS."""
    ends = [[batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b")] for batch in batches]
    if ends:
        a, b = (np.concatenate(own) for own in zip(*ends, strict=True))
        node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = at[:len(a)], at[len(a):]
        label = np.arange(len(node))
        while (label[a] != label[b]).any():
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
        other = label != np.arange(len(node))
        yield {"a": node[label[other]], "b": node[other]}


def _labelled(links: DataFrame) -> DataFrame:
    """node, component: links become stars in each partition first, so that long chains take few rounds."""
    parts = max(1, links.count() // LINKS)
    stars = settle(in_arrow(links.select("a", "b").repartition(parts), _as_stars, "a bigint, b bigint"))
    found = components(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), stars, [])
    release(stars)
    return found


def alike_in_block(node: np.ndarray, part: np.ndarray, side: np.ndarray, sizes: np.ndarray, values: np.ndarray, alike: float) -> list[tuple[int, int]]:
    """Links of a Jaccard similarity of `alike` or more that connect what such links connect, beyond the parts given.

    `values` holds the distinct shingles of one node after the other. With two sides, links are sought between them.
    A row's shingles look up who else has them, so that one pass over their lists counts it with all others.
    """
    stops = np.cumsum(sizes)
    shingle = np.unique(values, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(node)), sizes)[np.argsort(shingle, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(shingle))))
    label = np.unique(part, return_inverse=True)[1]
    if side.any() and not side.all():
        rows = np.flatnonzero(side == (side.sum() * 2 <= len(side)))
    else:  # of two rows in different parts one is outside of the largest
        rows = np.flatnonzero(label != np.bincount(label).argmax())
    links = []
    for x in rows.tolist():
        own = shingle[stops[x] - sizes[x]:stops[x]]
        start, count = first[own], first[own + 1] - first[own]
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(node))
        good = both >= alike * (sizes[x] + sizes - both) - 1e-9
        for y in np.flatnonzero(good & (label != label[x])).tolist():
            if label[y] != label[x]:
                links.append((int(node[x]), int(node[y])))
                label[label == label[y]] = label[x]
    return links


def alike_in_trees(left: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """a, b: pairs of `alike` or more that connect all such pairs of a tree, beyond its parts. left: node, tree, part, size.

    A tree is dealt into blocks of about BLOCK_ROWS rows or BLOCK_SHINGLES shingles, a large part into blocks of its own,
    and each two blocks meet in one group, except for those of the same part. Pairs are counted there and none leaves it
    but the links of a forest, so a tree of any size is many bounded groups.
    """
    parts = left.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    large = (F.col("n") * 2 >= BLOCK_ROWS) | (F.col("shingles") * 2 >= BLOCK_SHINGLES)
    parts = settle(parts.withColumns({"rest": ~large, "cell": F.when(large, F.col("part")).otherwise(F.lit(0))}))
    cells = settle(parts.groupBy("tree", "rest", "cell").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_ROWS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks")))
    place = F.struct("rest", "cell", "block")
    blocks = settle(cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tree", place.alias("i")))
    meet = blocks.join(blocks.withColumnRenamed("i", "j"), "tree").where("i <= j and (i.rest or j.rest or i.cell != j.cell)")
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("place"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("place"), F.lit(0).alias("side")), F.struct(F.col("j").alias("place"), F.lit(1).alias("side"))))
    meet = meet.select("tree", "i", "j", F.explode(sides).alias("s")).select("tree", "i", "j", "s.place", "s.side")
    dealt = (left.select("node", "tree", "part").join(parts.select("tree", "part", "rest", "cell"), ["tree", "part"]).join(cells, ["tree", "rest", "cell"])
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("tree", "node", "part", place.alias("place")))
    dealt = dealt.join(meet, ["tree", "place"]).join(sets.withColumnRenamed("key", "node"), "node")

    def work(group: pa.Table) -> pa.Table:
        shingles = group["shingles"].combine_chunks()
        shingles = pa.concat_arrays(shingles.chunks) if isinstance(shingles, pa.ChunkedArray) else shingles
        node, part, side = (group[c].to_numpy() for c in ("node", "part", "side"))
        sizes = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        links = alike_in_block(node, part, side, sizes, shingles.flatten().to_numpy(zero_copy_only=False), alike)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    found = settle(dealt.select("tree", "i", "j", "side", "node", "part", "shingles").groupBy("tree", "i", "j").applyInArrow(work, "a bigint, b bigint"))
    for done in (parts, cells, blocks):
        release(done)
    return found


def alike_links(rows: DataFrame, nodes: DataFrame, width: int, alike: float, bits_of_128: int, text: str) -> DataFrame:
    """a, b: pairs of a Jaccard similarity of `alike` or more that connect all such pairs of `nodes`.

    A forest of near pairs is counted first; good links make parts of its trees. Where a link fails, the pairs behind it
    are not known: the parts of its tree are counted against each other.
    """
    tree = settle(head_links(nodes, bits_of_128))
    ends = settle(tree.select(F.explode(F.array("a", "b")).alias("__node")).distinct())
    texts = rows.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__node"), text)
    texts = texts.join(F.broadcast(ends) if ends.count() <= BROADCAST else ends, "__node", "left_semi")
    sets = settle(shingle_sets(texts, width, "__node", text).dropDuplicates(["key"]))
    checked = settle(alike_pairs(tree, sets, alike))
    good = checked.where("alike").select("a", "b")
    failed = checked.where("not alike").select("a", "b")
    if failed.limit(1).count():
        whole = settle(_labelled(tree))
        open_ = whole.join(failed.select(F.col("a").alias("node")), "node").select("component").distinct()
        left = whole.join(open_, "component").withColumnRenamed("component", "tree")
        left = left.join(_labelled(good).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        left = settle(left.join(nodes.select("node", "size"), "node"))
        good = good.union(alike_in_trees(left, sets, alike))
        release(whole)
        release(left)
    links = settle(good)
    for done in (tree, ends, sets, checked):
        release(done)
    return links


def class_links(rows: DataFrame, width: int, bits: int, key: str, text: str) -> DataFrame:
    """a, b: links from one text of each class of near_duplicates() to the others, by their text hashes."""
    prints = settle(fingerprints(rows, width, key, text).select("text_hash", "fp").distinct())
    grouped = _labelled(settle(link(prints, bits))).withColumnRenamed("node", "fp")
    texts = settle(prints.join(grouped, "fp", "left").select(F.coalesce("component", "fp").alias("component"), "text_hash"))
    first = texts.groupBy("component").agg(F.min("text_hash").alias("a"))
    return texts.join(first, "component").where("a <> text_hash").select("a", F.col("text_hash").alias("b"))


def keep_one_of_each(rows: DataFrame, width: int = 5, alike: float = 0.8, bits_of_128: int = 40, key: str = "doc_id", text: str = "text",
                     class_width: int = 4, class_bits: int | None = None) -> DataFrame:
    """The rows of which no near copy with a smaller key is there, whole: one row of each class stays.

    With class_bits, texts in one class of near_duplicates() for class_width and class_bits are linked, besides those below.
    Texts are linked if the Jaccard similarity of their distinct shingles is `alike` or more, and so are chains of links;
    every link is counted on the shingles. Pairs to count share a shingle of their heads, which is exact, and differ in
    at most bits_of_128 bits: a Jaccard similarity of 0.8 is 19 of 128 in the mean with a deviation of 4, so that 40 are
    five deviations away. Texts without a word are alike. Rows without a key stay only in classes without any key, the
    one with the smallest text hash; of rows repeated with key and text one stays.
    """
    prints = settle(heads(rows, width, alike, key, text))
    nodes = prints.withColumnRenamed("text_hash", "node").drop("doc").dropDuplicates(["node"])
    links = alike_links(rows, nodes, width, alike, bits_of_128, text)
    if class_bits is not None:
        links = settle(links.unionByName(class_links(rows, class_width, class_bits, key, text)))
    first = F.struct(F.col("doc").isNull().alias("no_key"), F.col("doc").alias("doc"), F.col("text_hash").alias("text_hash"))
    stay = (prints.select("doc", "text_hash").join(_labelled(links).withColumnRenamed("node", "text_hash"), "text_hash", "left")
            .groupBy(F.coalesce("component", "text_hash").alias("component")).agg(F.min(first).alias("first"))
            .select("first.doc", F.col("first.text_hash").alias("__hash")))
    stay = settle(stay.withColumn("__key", plain_key("doc")))
    marked = rows.withColumn("__key", plain_key(key)).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return only_these(marked, stay, ["__key", "__hash"])
