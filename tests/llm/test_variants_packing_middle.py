"""Spelling variants, best-fit packing and fill-in-middle against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import best_fit, middle, spelling
from quireflow.llm.queries import QUERIES, tokenizer_path
from test_llm import DOCS, none_of, odd_documents, special_texts

# spelling variants


def one_letter_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_counts(rows, letters=6, count=5, every=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= count}


def plain_variants(counts, times=5):
    by = defaultdict(set)  # words by what is left without one letter
    for w in counts:
        by[w].add(w)
        for k in range(len(w)):
            by[w[:k] + w[k + 1:]].add(w)
    near = defaultdict(set)
    for some in by.values():
        for a in some:
            near[a] |= {b for b in some if a != b and b not in near[a] and one_letter_apart(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def got_variants(found):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_documents(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = plain_variants(plain_counts(rows))
    assert got_variants(QUERIES["op11_spelling_variants"](spark, folder)) == expected
    assert any(f for _, f, *_ in expected) and any(n > 1 for _, _, _, _, n, _ in expected)


def test_variants_odd_rows(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcÀéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    texts = [(k, " ".join(rng.choices(base, k=rng.randrange(1, 300)))) for k in range(40)]
    long = "ab" * 1500
    texts += [(None, None), (None, " ".join(["damage"] * 9)), (41, ""), (42, f"{long} {long[:-1]} {long[:500] + 'x' + long[500:]} " * 6), (42, "aaaaaa aaaaaaa aaaaaaaa " * 30), (42, "aaaaaa aaaaaaa aaaaaaaa " * 30),
              (43, "STRASSE Stra\u00dfe strasse \u00c9TUDES \u00e9tudes \u0130stanbul " * 7), (44, "\u0100abcdef\u0100abcdeg " * 8), (45, "abcdef\u00d7abcdef " * 6)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id bigint, text string, word string, n int").repartition(5)
    for every in (199, 3, 1):
        expected = plain_variants(plain_counts(texts, every=every))
        assert got_variants(spelling.variants(docs, every=every)) == expected
    assert spelling.variants(none_of(spark, DOCS)).count() == 0
    assert spelling.variants(odd_documents(spark)).where("n < 5").count() == 0


def test_variants_hot_group(spark):
    """One group larger than a block, and ties of the count."""
    letters = "abcdefghijklmnopqrstuvwxyz\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e6\u00e7\u00e8\u00e9"
    words = [f"prefix{a}{b}" for a in letters for b in letters] + ["prefixabc", "prefixa", "prefix"]
    counts = {w: 5 + len(w) % 2 * 40 for w in words}
    found = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    got = Counter((r.word, r.near) for r in found.collect())
    assert set(got.values()) == {1}
    by = defaultdict(set)
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) < 2 and a != b and one_letter_apart(a, b):
                by[a].add(b)
    assert set(got) == {(a, b) for a, some in by.items() for b in some}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab\u00e9", min_size=1, max_size=9), min_size=1, max_size=140, unique=True))
def test_position_index(words):
    width = max(map(len, words)) + 1
    letters = np.array([[ord(c) % 60 + 1 for c in w] + [0] * (width - len(w)) for w in words])
    lengths = np.array([len(w) for w in words])
    index = spelling.PositionIndex(letters, lengths, 61)
    found = set()
    for length in set(lengths):
        rows = np.flatnonzero(lengths == length)
        query, word = index.near(letters[rows], int(length))
        found |= {(words[rows[q]], words[w]) for q, w in zip(query, word, strict=True)}
    assert found == {(a, b) for a in words for b in words if a != b and one_letter_apart(a, b)}


# best-fit decreasing


def plain_best_fit(lengths, capacity):
    """Room left in each bin, one piece after the other."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit(case):
    capacity, lengths = case
    runs, bins = best_fit.plan(Counter(lengths), capacity)
    used, placed = defaultdict(list), Counter()
    for r in runs:
        following = [o.piece for o in runs if o.length == r.length and o.piece > r.piece]
        n = min(following, default=Counter(lengths)[r.length]) - r.piece
        placed[r.length] += n
        for k in range(n):
            used[r.bin + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert placed == Counter(lengths) and used.keys() == set(range(bins))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in used.values()) == plain_best_fit(lengths, capacity)


def check_packed(got, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    expected = Counter()
    for key, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            expected[(key, k, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert pieces == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == plain_best_fit([r.length for r in got], capacity)


def test_best_fit_documents(spark, folder):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_packed(QUERIES["op12_best_fit"](spark, folder).collect(), texts)


def test_best_fit_odd_rows(spark, monkeypatch):
    docs = odd_documents(spark).select("doc_id", "text", F.lit("x").alias("length"), F.lit(1).alias("chunk")).unionByName(
        spark.createDataFrame([(100 + k, t, "", k) for k, t in enumerate(special_texts())], "doc_id bigint, text string, length string, chunk int"))
    docs = docs.unionByName(spark.range(3000).selectExpr("id % 2 AS doc_id", "'a b c' AS text", "'' AS length", "0 AS chunk")).repartition(3)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for chunk, together in ((2048, 4096), (7, 3)):
        monkeypatch.setattr(best_fit, "CHUNK_PIECES", chunk)
        monkeypatch.setattr(best_fit, "CHUNKS_TOGETHER", together)
        check_packed(best_fit.pack(docs, tokenizer_path()).collect(), texts)
    assert best_fit.pack(none_of(spark, DOCS), tokenizer_path()).count() == 0


# fill-in-middle


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_rotate(data, a, b):
    low, high = sorted((min(a, len(data)), min(b, len(data))))
    buffer = bytearray(data)
    middle.rotate(buffer, low, high, len(data))
    assert bytes(buffer) == data[:low] + data[high:] + data[low:high]


def test_rotate_long(monkeypatch):
    monkeypatch.setattr(middle, "_SWAP", 3)
    for size in range(12):
        for cut in range(size + 1):
            buffer = bytearray(range(size))
            middle.rotate(buffer, 0, cut, size)
            assert list(buffer) == [*range(cut, size), *range(cut)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab<>PSM\n\u00e9\U0001f600")), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_arrange_and_rebuild(text, a, b, form):
    raw = text.encode()
    if any(sign in raw for sign in middle.SENTINELS):
        return
    ends = [0, *middle.line_ends(raw).tolist()]
    assert len(ends) - 1 == len(re.findall(r"[^\n]*\n|[^\n]+", text))
    low, high = sorted((ends[a % len(ends)], ends[b % len(ends)]))
    p, m, s = raw[:low], raw[low:high], raw[high:]
    out = bytes(middle.arrange(raw, low, high, form))
    assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
    assert bytes(middle.rebuild(out, form)) == raw


def plain_middle(key, text, seed=7, rate=100, suffix_first=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (key, n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h4 % 100 < suffix_first:
        return (key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "suffix_first"), [(100, 50), (40, 100), (0, 0)])
def test_middle_odd_rows(spark, rate, suffix_first):
    more = ["one line", "a\nb\nc", "a\n\n\nb\n", "\n", "\n\n", "x <P> y\nz", "<S", "<\n<\n<S\n>", "\u00e9\n\u00e9\U0001f600\n\u00e9", "\r\n\r\n", "line\n" * 50_000, "<M>"]
    docs = odd_documents(spark).selectExpr("doc_id", "text", "lang AS form", "n_chars AS output").unionByName(
        spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(more * 3, 50)], "doc_id bigint, text string, form string, output bigint")).repartition(3)
    found = middle.restore(middle.fill_in_middle(docs, rate=rate, suffix_first=suffix_first))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found.collect())
    expected = Counter()
    for r in docs.collect():
        row = plain_middle(r.doc_id, r.text or "", 7, rate, suffix_first)
        expected[(*row, r.text or "")] += 1
    assert got == expected
    assert {f for _, _, f, *_ in got} == {(100, 50): {"plain", "psm", "spm"}, (40, 100): {"plain", "spm"}, (0, 0): {"plain"}}[rate, suffix_first]


def test_middle_no_rows(spark):
    assert middle.restore(middle.fill_in_middle(none_of(spark, DOCS))).count() == 0
    part = spark.createDataFrame([(1, None, "psm"), (2, "x", None), (3, "x", "plain")], "k int, output string, form string")
    assert {r.k: r.restored for r in middle.restore(part).collect()} == {1: None, 2: None, 3: "x"}
