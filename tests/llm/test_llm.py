"""The operators of quireflow.llm against brute-force versions, and on rows that are odd in every way."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import load_llm
from compare import compare
from quireflow.llm import chaining, hyperdimensional, impact_search, licenses, mixing, packing, simhash, text_density, toxicity
from quireflow.llm.digest_index import DigestIndex, keep_first_copies
from quireflow.llm.queries import QUERIES, SQL, tokenizer_path
from quireflow.plans.registry import Query

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use themselves
ODD = DOCS + ", score double, kept boolean, rate double, fp bigint, component string, hash string, x int, digest string, tokens string, licenses string"


def words(rng: random.Random, n: int, size: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_documents(spark):
    rng = random.Random(5)
    long = words(rng, 30_000)
    texts = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "?!", None), (5, "Same text here", "en"), (6, "Same text here", None), (6, "Same text here", None),
             (None, "Same text here", "en"), (None, None, None), (7, long, "en"), (8, long[:-6] + " other", "de"), (9, "\U0001f600\u0000퟿ ​ x", "xx"), (-3, "MiXeD Ünïcödé İ ſ", "")]
    rows = [(k, t, lang, None, None, None, None, None, None, None, None, None, None, None, None) for k, t, lang in texts]
    return spark.createDataFrame(rows, ODD)


def special_texts():
    """Texts with the strings of the tokenizer's added tokens, whole, broken up and in other cases."""
    return ["hello <|endoftext|> world", "a<|startoftext|>b. <|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext", "\u0130 <|endoftext|>", "a <| b |> <|endoftext|><|endoftext|>"]


def none_of(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, folder, name):
    verdict, rows, _, _, note = compare(spark, duck, Query(name, (), QUERIES[name], SQL[name]), folder)
    assert verdict == "same" and rows, note


def test_registered():
    runs, sql = load_llm()
    assert {int(m[1]) for n in runs if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in runs and set(sql) <= set(runs)


# exact dedup


def test_digest_index(spark, tmp_path):
    docs = odd_documents(spark)
    index = DigestIndex(spark, "seen_a", f"file://{tmp_path}/a", 4)
    found = index.absorb(docs)
    assert found.columns == ["doc_id", "digest", "keep_id", "group_size", "kept"]
    rows = [(r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in found.collect()]
    expected = Counter()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[(i, hashlib.sha256(text.encode()).digest(), top, len(ids), i == top)] += 1
    assert Counter(rows) == expected
    # the same rows again decide the same and add nothing; new copies of what is known go, even with larger ids
    before = index.rows().count()
    assert Counter((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in index.absorb(docs).collect()) == expected
    assert index.rows().count() == before
    late = spark.createDataFrame([(100, "Same text here"), (101, "new"), (102, "new")], "doc_id bigint, text string")
    again = DigestIndex(spark, "seen_b", f"file://{tmp_path}/a", 4)  # the folder under another name, as after a restart
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.absorb(late).collect()} == {(100, 6, False), (101, 102, False), (102, 102, True)}
    assert again.absorb(none_of(spark, DOCS)).count() == 0


def test_keep_first_copies(spark, tmp_path):
    docs = odd_documents(spark)
    found = keep_first_copies(docs, DigestIndex(spark, "seen_c", f"file://{tmp_path}/c", 2).absorb(docs))
    assert found.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.text or "") for r in found.collect()) == sorted(
        (max((i if i is not None else -99) for i in ids), t) for t, ids in
        ((t, [r.doc_id for r in docs.collect() if (r.text or "") == t]) for t in {r.text or "" for r in docs.collect()}))


# licences


def test_license_texts(spark):
    mit = ("The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
           "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit "
           "persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial "
           "portions of the Software.\n")
    cases = [(1, mit), (2, "Some words\nLicensed under CC BY-NC 4.0.\nmore"), (3, "Released under the MIT License."), (4, "The MIT Licenses are many."), (5, None), (6, ""),
             (7, "Released under the MIT License. Licensed under the Apache License, Version 2.0. Released under the MIT License."),
             (8, "x. this work is  licensed under the gnu general public license, VERSION 3!"), (9, "SPDX-License-Identifier: MIT\nint x;"), (9, "SPDX-License-Identifier: MIT\nint x;"),
             (10, "// SPDX-License-Identifier: Apache-2.0\n" + "a b. " * 50_000)]
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
              "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\n"
              "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n")
    gpl = ("This program is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{1} either version {2} of the License, or\n"
           "(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
           "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License\n"
           "along with this program.  If not, see <https://www.gnu.org/licenses/>.\n")
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n")
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n"
           "   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
           "   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n")
    notices = [("Apache-2.0", apache), ("GPL-3.0-or-later", gpl.format(":", ",", 3)), ("GPL-2.0-or-later", gpl.format(";", ";", 2)), ("MPL-2.0", mpl), ("BSD-3-Clause", bsd), ("MIT", mit)]
    wrappings = [lambda t: t, lambda t: "/*\n" + "".join(f" * {line}\n" for line in t.split("\n")) + " */\nint main;", lambda t: "".join(f"# {line}\n" for line in t.split("\n")) + "x = 1",
                 lambda t: t.replace("\n", "\r\n"), lambda t: "Some words before\n\n" + t + "\nand behind."]
    standard = [(1000 + 10 * k + n, wrap(text), name) for k, (name, text) in enumerate(notices) for n, wrap in enumerate(wrappings)]
    seen = {r.doc_id: list(r.licenses) for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t, _ in standard], "doc_id int, text string")).collect()}
    assert seen == {i: [name] for i, _, name in standard}
    found = licenses.scan_licenses(spark.createDataFrame([(k, t, "x") for k, t in cases], "doc_id int, text string, licenses string"))
    got = sorted((r.doc_id, tuple(r.licenses), r.n_sentences) for r in found.collect())
    assert got == [(1, ("MIT",), 3), (2, ("CC-BY-NC-4.0",), 1), (3, ("MIT",), 1), (4, (), 0), (5, (), 0), (6, (), 0), (7, ("Apache-2.0", "MIT"), 3), (8, ("GPL-3.0",), 1),
                   (9, ("MIT",), 1), (9, ("MIT",), 1), (10, ("Apache-2.0",), 1)]
    assert licenses.scan_licenses(none_of(spark, DOCS)).count() == 0
    assert licenses.scan_licenses(odd_documents(spark)).where("size(licenses) > 0").count() == 0


def spelled(tree) -> list[str]:
    """Texts a parsed pattern fits: every alternative, every optional part with and without, each class by its first character."""
    texts = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "ANY":
            parts = ["x"]
        elif name == "IN":
            parts = [chr(a if str(kind) == "LITERAL" else a[0]) for kind, a in arg]
        elif name == "BRANCH":
            parts = [t for branch in arg[1] for t in spelled(branch)]
        elif name == "SUBPATTERN":
            parts = spelled(arg[3])
        else:
            assert name == "MAX_REPEAT"
            parts = [""] * (arg[0] == 0) + spelled(arg[2])
        texts = [a + b for a in texts for b in parts]
    return texts


def test_license_marks_are_in_every_sentence(spark):
    cases = [(name, t) for name, pattern in licenses.SENTENCES for t in spelled(re._parser.parse(pattern))]
    assert all(re.fullmatch(dict(licenses.SENTENCES)[name], t) for name, t in cases) and {n for n, _ in cases} == {n for n, _ in licenses.SENTENCES}
    assert [c for c in cases if not re.search(licenses.MARKS, c[1])] == []
    texts = ["This work is released under CC BY 4.0.", "// Released under Creative Commons\n// Attribution 4.0 International", "Released under CC\n# BY-SA 4.0", "Released under the CC BY-NC 4.0.",
             "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of merchantability or fitness for a particular purpose."]
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert [got[k][0] for k in range(4)] == [["CC-BY-4.0"], ["CC-BY-4.0"], ["CC-BY-SA-4.0"], ["CC-BY-NC-4.0"]] and got[4] == ([], ["gpl-hope"])


# top-k search


def brute_top_k(vectors: dict[int, list[int]], asks, k):
    out = []
    for q in asks:
        scored = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [50, 16384])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(impact_search, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(400, [0.0] * 8), (500, [1.0, 2.0])]  # ties, zeros, a short one
    bad = [(600, None), (601, [None, 1.0]), (602, [float("nan"), 0.0]), (603, [float("inf")]), (None, [1.0] * 8), (604, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + rows[:3]], "vec_id bigint, embedding array<double>, rank int, score int")
    found = impact_search.top_k(frame, F.col("vec_id") % 50 == 0)
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    assert sorted(map(tuple, found.collect())) == brute_top_k(vectors, [i for i in vectors if i % 50 == 0], 10)
    few = impact_search.top_k(frame.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert impact_search.top_k(frame.where("false"), F.lit(True)).count() == 0


def test_search_stops_early():
    """Vectors in clusters: the possible members are few long before all postings are read."""
    import pandas as pd

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 5, (2000, 16)), rng.normal(0, 5, (20, 16)) + 900]).astype(int)
    rows = impact_search._index_block(pd.DataFrame({"block": 0, "vec_id": range(len(values)), "parts": list(values)}))
    block = impact_search._Block(rows.iloc[0])
    assert len(block._possible(np.zeros(len(values), bool), values[-1], 10)) <= 64
    assert set(block.best(2019, values[-1], 10)[0]) <= set(range(2000, 2020))


# language identification


def test_trigrams_and_bundles():
    texts = ["Ab, c!", "", "?", "Ñ", "a\nb " * 3000]
    doc, keys = hyperdimensional.trigrams(texts)
    said = defaultdict(list)
    for d, k in zip(doc, keys):
        said[int(d)].append("".join(chr(c) if c else "_" for c in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF)))
    assert said[0] == ["_ab", "ab_", "b_c", "_c_"] and 1 not in said and 2 not in said and said[3] == ["_ñ_"]
    sums = hyperdimensional.bundles(doc, keys, len(texts))
    expected = np.zeros_like(sums)
    for d, k in zip(doc, keys):
        a, b, c = (hyperdimensional._letter(int(x)).astype(int) for x in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))
        expected[d] += np.roll(a, 2) * np.roll(b, 1) * c
    assert (sums == expected).all()
    # many rows with few trigrams each take the other way to the same sums
    row = np.arange(500) % 300
    keys = (np.arange(500) % 7 + 97) << 42 | (np.arange(500) + 97) << 21 | 97
    apart = hyperdimensional.bundles(row, keys, 300)
    assert all((apart[r] == hyperdimensional.bundles(np.zeros((row == r).sum(), int), keys[row == r], 1)[0]).all() for r in range(300))


def test_language(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op3_language_id"](spark, folder)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = {r.doc_id: r.lang for r in docs.collect()}
    own = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in own) >= 0.95 * len(own)
    odd = odd_documents(spark)
    prototypes = hyperdimensional.fit_prototypes(odd)
    got = hyperdimensional.predict(odd, prototypes, {"doc_id": F.col("doc_id"), "score0": F.col("score")}).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in hyperdimensional.predict(odd, {}, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert hyperdimensional.fit_prototypes(none_of(spark, DOCS)) == {}


# toxicity


def test_features_are_hashes_of_words():
    doc, place = toxicity.features(["Bad, bad word", "", "x", "bad wordy"])
    by = defaultdict(list)
    for d, p in zip(doc, place):
        by[int(d)].append(int(p))
    assert 1 not in by and len(by[2]) == 1 and len(by[0]) == 3 + 2 + 1 and len(by[3]) == 2 + 1 + 1  # wordy has one stem: word
    assert by[0][0] == by[0][1] == by[3][0] and by[0][3] != by[0][4]
    again = toxicity.features(["something else " * 1000, "Bad, bad word"])
    assert [int(p) for d, p in zip(*again) if d == 1] == by[0]


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["idiot", "scum", "trash"]
    rows, labels = [], []
    for i in range(1500):
        text, toxic = words(rng, rng.randrange(5, 200), 900).split(), i % 5 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), i))
        if i < 1200:
            labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1), (77777, 1), (5, 1)]
    docs = spark.createDataFrame(rows + [(9000, None, 0), (9001, "", 0), (None, "x y", 0), (9002, "w1 " * 60_000 + "idiot", 0), (9002, "w1 " * 60_000 + "idiot", 0)], "doc_id bigint, text string, score int")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), shard_rows=700)
    assert 0 < len(model.places) < 3000
    got = toxicity.score(docs, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    right = [(by[i] >= 0.5) == (i % 5 == 0) for i in range(1200, 1500)]
    assert sum(right) >= 0.97 * len(right)
    assert by[9000] == by[9001] < 0.5 <= by[9002] and [r.score for r in got if r.doc_id == 9002] == [by[9002]] * 2
    # the same rows in other partitions, the other way round, learn the same model
    turned = docs.repartition(7, F.xxhash64("text")).sortWithinPartitions(F.desc("doc_id"))
    other = toxicity.fit(turned, spark.createDataFrame(labels[::-1], "doc_id bigint, toxic int"), shard_rows=700)
    assert (other.places == model.places).all() and (other.weights == model.weights).all() and other.bias == model.bias
    blank = toxicity.fit(none_of(spark, DOCS), none_of(spark, "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(docs, blank, {"doc_id": F.col("doc_id")}).collect()} == {0.5}


# main text


def test_main_text_cases():
    p = "<p>" + "Words of the story, one after another, and more of them. " * 3 + "</p>"
    said = ("Words of the story, one after another, and more of them. " * 3).strip()
    cases = [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<html><body></body></html>", ""), ("<script>x</script>", ""),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>Title &lt;1&gt;</h1>{p}{p}</article><div class='ad'>Buy this now, it is cheap.</div><footer>&copy; us</footer>", f"Title <1>\n{said}\n{said}"),
        (f"<div id=sidebar>{p}</div><div><div class='post'>{p}{p}{p}</div><div class='comments'>{p}</div></div>", f"{said}\n{said}\n{said}"),
        (f"<article><h1>T</h1><p><b>bold start<br>{p}<!-- <p>no</p> --><form><p>Your name</p></form></article>", f"T\nbold start\n{said}"),
        (f"<div class='page with-sidebar'><header><h1>Site</h1>{p}</header><div class='cookie-notice'>{p}</div><div class='post'><div class='entry-header'><h2>Head</h2></div>{p}{p}<aside>{p}</aside></div>"
         f"<section id='comments'><article>{p}</article></section><div role='navigation'>{p}</div><div class='ad-unit'>{p}</div></div>", f"Head\n{said}\n{said}"),
        (f"<main>{p}<ul><li>one<li>two</ul><style>p{{}}</style><table><tr><td>a<td>b</table></main>", f"{said}\none\ntwo\na\nb"),
        ("<p>a  b\n\tc&nbsp;d</p>" * 2, "a b c d\na b c d"), ("<p title='x > y'>seen</p><p title=\"", "seen"), ("<" * 1000 + "p>", None), ("<div>" * 3000 + "deep", "deep"),
    ]
    # names that only mention boilerplate say nothing of what they are on
    for name in ("overflow-hidden", "has-ads", "comments-open", "nav-closed", "fixed-header", "with-share", "has-banner", "related-reading", "no-sidebar", "entry-header", "headerless"):
        cases += [(f"<div class='{name}'><h2>Head</h2>{p * 6}</div>", "\n".join(["Head"] + [said] * 6)), (f"<body class='{name}'><div id='{name}'><article><h2>Head</h2>{p * 6}</article></div></body>", "\n".join(["Head"] + [said] * 6))]
    inner = f"<section class='related-work'>{p}</section><p class='copyright-law'>On rights.</p><ul class='share-prices'><li>one<li>two</ul>"
    cases.append((f"<article><header><h1>Top</h1></header>{p * 2}{inner}<footer>{p}</footer></article><div class='related-posts'>{p}</div><div id='adBox'>{p}</div><div class='side-bar left'>{p}</div>", f"Top\n{said}\n{said}\n{said}\nOn rights.\none\ntwo"))
    for page, expected in cases:
        got = text_density.main_text(page)
        assert expected is None or got == expected, (page[:200], got)


def test_main_text_of_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op9_main_text"](spark, folder).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        assert got[r.page_id].text == "\n".join(x for x in lines if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(None, None, "x"), (1, "<p>x", "y"), (1, "<p>x", "y")], "page_id bigint, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in text_density.extract(odd, {"page_id": F.col("page_id")}).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert text_density.extract(odd.where("false"), {"page_id": F.col("page_id")}).count() == 0


# packing


@pytest.mark.parametrize("tokens", [*range(1, 300), 2047, 2048, 2049, 4032, 4095, 4096, 4097, 50_000])
def test_cut(tokens):
    pieces = packing.cut(tokens)
    assert sum(pieces) == tokens and all(0 < p <= 4096 for p in pieces)
    assert len(pieces) <= tokens // 4096 + 6 and all(4096 - 4096 // p * p <= 64 for p in pieces)


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]).unionByName(
        odd_documents(spark).where("doc_id <> 6").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")).unionByName(
        spark.createDataFrame([(2_000_000 + k, t, None, None, None) for k, t in enumerate(special_texts())], DOCS))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.pack(docs.withColumn("length", F.lit("x")), tokenizer_path()).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in got) >= 0.95 * 4096 * len(bins)
    assert packing.pack(none_of(spark, DOCS), tokenizer_path()).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id bigint, text string"), tokenizer_path()).collect()
    assert sorted(r.length for r in twice) == [1, 3, 3, 3] and len({r.sequence_id for r in twice}) == 1


# SimHash


def brute_fingerprint(text: str, width: int) -> int:
    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(own[i:i + width]) for i in range(len(own) - width + 1)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints: dict[int, int], bits: int) -> dict[int, int]:
    best = {i: i for i in prints}
    ids = sorted(prints)

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            lo, hi = sorted((root(a), root(b)))
            best[hi] = lo
    return {i: root(i) for i in ids}


def test_fingerprints_and_classes(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t, 4) for i, t in texts.items()}
    got = {r.doc_id: r for r in QUERIES["op6_simhash_classes"](spark, folder).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: format(p, "016x") for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_classes(prints, 4)
    odd = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(odd) == 13 and {r.fp for r in odd if r.doc_id in (1, 2, 3)} == {0} and {r.component_id for r in odd if r.fp == 0} == {1}
    assert {r.component_id for r in odd if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(none_of(spark, DOCS)).count() == 0


@pytest.mark.parametrize("chunk", [3, 4096])
@pytest.mark.parametrize("bits", [0, 4, 10])
def test_links_keep_classes(spark, monkeypatch, bits, chunk):
    """Random values, chains of near ones and a dense cluster, also with values of partitions split into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "_PAIRS", 50)
    rng = random.Random(bits)
    values = [rng.getrandbits(64) for _ in range(150)] + [0]
    for _ in range(150):
        near = rng.choice(values)
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            near ^= 1 << b
        values.append(near)
    values += [values[0] ^ (1 << b) for b in range(64)]
    prints = dict(enumerate(values))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    frame = spark.createDataFrame(signed, "doc bigint, fp bigint")
    links = simhash.link(frame, bits)
    found = {r.fp: r.component_id for r in simhash.classes(frame, links).collect()}
    assert {i: found[v] for i, v in signed} == brute_classes(prints, bits)


def test_forest_is_small_and_whole():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 5000), rng.integers(300, 900, 5000)
    weight = rng.integers(1, 9, 5000)
    tree = simhash.forest(a, b, weight)
    label = np.arange(900)
    for k in tree:
        x, y = label[a[k]], label[b[k]]
        assert x != y  # no cycle
        label[label == y] = x
    assert (label[a] == label[b]).all()
    assert len(simhash.forest(a[:0], b[:0], weight[:0])) == 0


def test_plans_are_complete():
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for rows in (10, 10_000, 10_000_000):
        for bits in (0, 1, 4, 10):
            plan = simhash.plan_probes(sample, rows, bits)
            assert sum(r + 1 for r in plan.radii) == bits + 1
            assert all(a & b == 0 for a, b in itertools.combinations(plan.masks, 2))
    assert simhash.plan_probes(np.zeros(0, np.uint64), 0, 4).radii


def test_keep_one_of_each(spark):
    rng = random.Random(8)
    base = words(rng, 400).split()
    rows = [(10, " ".join(base))]
    for i in range(11, 20):
        own = base[:]
        for _ in range(2):
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(i, words(rng, 300)) for i in range(20, 40)] + [(None, " ".join(base)), (None, words(rng, 50)), (21, "tiny"), (21, "tiny"), (50, None), (51, "")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept)
    assert ids == sorted([-1, 10, *range(20, 40), 21, 50])


def test_near_dedup_of_the_pipeline_takes_simhash_classes(spark, folder):
    import corpus_pipeline

    rng = random.Random(12)
    # repeats rule the fingerprint: these two share a class, and few of their distinct shingles
    texts = ["again " * 300 + words(rng, 30), "again " * 300 + words(rng, 30), words(rng, 200), words(rng, 200)]
    rows = spark.createDataFrame([(k + 1, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, folder).collect()} == {1, 3, 4}
    assert simhash.keep_one_of_each(rows).count() == 4


def test_alike_in_block():
    """The links of a block connect with the parts given what all pairs of the limit connect, with one side and with two."""
    rng = np.random.default_rng(23)
    for n in (1, 2, 9, 60):
        base = rng.choice(10**6, 60, replace=False)
        sets = [np.unique(np.concatenate((base[rng.random(60) < 0.93], rng.choice(10**6, rng.integers(0, 4))))) for _ in range(n)] + [np.zeros(0, np.int64)]
        node = rng.permutation(n + 1) + 100
        alike = [(a, b) for a, b in itertools.combinations(range(n + 1), 2)
                 if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        part = np.arange(n + 1)
        for a, b in alike[::3]:
            part[part == part[b]] = part[a]
        for side in (np.zeros(n + 1, np.int64), rng.integers(0, 2, n + 1)):
            two = side.any() and not side.all()
            links = simhash.alike_in_block(node, part, side, np.array([len(s) for s in sets]), np.concatenate(sets), 0.8)
            at = {int(v): k for k, v in enumerate(node)}
            got = [(min(at[a], at[b]), max(at[a], at[b])) for a, b in links]
            assert set(got) <= set(alike) and len(links) <= n

            def labels(pairs, label):
                for a, b in pairs:
                    label[label == label[b]] = label[a]
                return label

            want = labels([(a, b) for a, b in alike if not two or side[a] != side[b]], part.copy())
            found = labels(got, part.copy())
            assert all(found[a] == found[b] for a, b in itertools.combinations(range(n + 1), 2) if want[a] == want[b])


@pytest.mark.parametrize("block", [2048, 2])
def test_every_pair_of_jaccard_080_is_linked_and_none_under(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "CHUNK", 5)
    monkeypatch.setattr(simhash, "_PAIRS", 40)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(17)
    sets = lambda t: {" ".join(t[i:i + 5]) for i in range(len(t) - 4)}
    texts, line = {}, words(rng, 12).split()
    for i in range(120):
        base = words(rng, rng.randrange(60, 400)).split() + (line if i % 2 else [])
        texts[10 * i] = base
        for j in range(1, 4):
            own = base[:]
            for at in rng.sample(range(len(own)), max(1, int(len(own) * rng.choice((0.01, 0.018, 0.024, 0.04, 0.07))))):
                own[at] = f"new{at}"
            texts[10 * i + j] = own
    shingles = {k: sets(t) for k, t in texts.items()}
    label, seen = {k: k for k in texts}, []
    for a, b in itertools.combinations(sorted(texts), 2):
        same = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
        if a // 10 == b // 10:
            seen.append(same)
        if same >= 0.8:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    assert sum(0.8 <= s < 0.9 for s in seen) > 80 and sum(0.5 < s < 0.8 for s in seen) > 80
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {k for k in texts if label[k] == k}


# mixing


def test_mixing_meets_targets(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    domains = labels.selectExpr("doc_id", "CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS domain")
    got = mixing.mix(docs, domains, {"good": 3, "poor": 1}).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(sum(r.posteriors.values()) - 1) < 1e-9 for r in got)
    total = sum(r.tokens for r in got)
    for d, share in (("good", 0.75), ("poor", 0.25)):
        assert abs(sum(r.rate * r.tokens * r.posteriors[d] for r in got) / total - share) < 1e-3
    truth = {r.doc_id: r.domain for r in domains.collect()}
    said = [max(r.posteriors, key=r.posteriors.get) == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert sum(said) >= 0.85 * len(said)


def test_mixing_like_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    t = rng.integers(1, 500, 200)
    frame = spark.createDataFrame([(i, int(t[i]), [float(x) for x in p[i]]) for i in range(200)], "i int, __tokens bigint, __posteriors array<double>")
    target = np.array([0.9, 0.1, 0.0]) * t.sum()
    steps = mixing.fit_rates(frame, target.tolist())
    rates = np.array([r[0] for r in frame.orderBy("i").select(mixing.rate(F.col("__posteriors"), steps)).collect()])
    # the same problem by the plain method: many small projected steps
    weight = np.linalg.inv((p * t[:, None]).T @ p)
    plain = np.ones(200)
    for _ in range(20_000):
        plain = np.maximum(0, plain - 0.5 * p @ (weight @ ((plain * t) @ p - target)))
    cost = lambda r: ((r * t) @ p - target) @ weight @ ((r * t) @ p - target)
    assert (rates >= 0).all() and cost(rates) <= cost(plain) + 0.01 * cost(np.ones(200))


def test_mixing_odd_rows(spark):
    odd, none = odd_documents(spark), none_of(spark, "doc_id bigint, domain string")
    assert {r.rate for r in mixing.mix(odd, none, {"a": 1}).collect()} == {1.0}
    labelled = spark.createDataFrame([(5, "a"), (7, "b"), (8, None), (None, "a"), (5, "b")], "doc_id bigint, domain string")
    assert mixing.mix(odd, labelled, {"a": 1, "zz": 3}).count() == odd.count()
    assert mixing.mix(none_of(spark, DOCS), labelled, {"a": 1}).count() == 0
    again = mixing.resample(odd, none, {"a": 1})
    assert again.columns == odd.columns and again.count() == odd.count()


# repeated passages


def test_chain_is_the_best_chain():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 9)
        x, y = (np.array([rng.randrange(40) for _ in range(n)]) for _ in range(2))
        s = np.array([rng.randrange(3, 8) for _ in range(n)])

        def score(own):
            total = 0.0
            for a, b in zip(own, own[1:]):
                dx, dy = x[b] - x[a] - s[a], y[b] - y[a] - s[a]
                if dx < 0 or dy < 0:
                    return -1.0
                total -= 0.2 * (dx + dy)
            return total + sum(s[k] for k in own)

        best = max(score(own) for r in range(1, n + 1) for own in itertools.permutations(range(n), r) if list(own) == sorted(own, key=lambda k: (x[k], y[k])))
        chains = chaining.chain(x, y, s)
        assert sorted(k for c in chains for k in c) == list(range(n))
        assert abs(score(list(chains[0])) - best) < 1e-9


def test_every_shared_run_has_a_seed():
    rng = np.random.default_rng(2)
    run = rng.integers(0, 1 << 63, chaining.WINDOW + chaining.K - 1).astype(np.uint64)
    for _ in range(200):
        seeds = []
        for _ in range(2):
            before, after = (rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
            at, h = chaining.minimizers(np.concatenate((before, run, after)))
            seeds.append({int(v) for a, v in zip(at, h) if len(before) <= a <= len(before) + len(run) - chaining.K})
        assert seeds[0] & seeds[1]


def test_passages(spark):
    rng = random.Random(11)
    shared, fuzzy = words(rng, 60).split(), words(rng, 90).split()
    rows = {}
    for i in range(30):
        own = words(rng, 150).split()
        if i < 10:
            own[40:40] = shared
        if 8 <= i < 14:
            copy = fuzzy[:]
            for k in rng.sample(range(90), 5):
                copy[k] = f"new{k}"
            own[20:20] = copy
        if 14 <= i < 16:
            own[10:10] = shared[:30]  # too short to tell
        rows[i] = " ".join(own)
    rows[30], rows[31] = rows[25], rows[25].upper()
    data = [(i, t, 1) for i, t in rows.items()] + [(40, None, 1), (41, "", 1), (42, "a b c", 1), (None, rows[3], 1), (3, rows[3], 1)]
    got = chaining.repeated_passages(spark.createDataFrame(data, "doc_id bigint, text string, similarity int")).collect()
    assert {r.doc_id for r in got} == {*range(14), 25, 30, 31} == {r.other_doc_id for r in got}
    for i in range(10):
        assert any(r.start_word <= 40 + 90 * (i >= 8) + 2 and r.end_word >= 98 + 90 * (i >= 8) for r in got if r.doc_id == i)
    assert any(r.start_word == 0 and r.end_word == 150 for r in got if r.doc_id == 30)
    assert all(r.n_words >= 50 and 0.8 <= r.similarity <= 1 for r in got)
    both = {(r.doc_id, r.start_word, r.end_word, r.other_doc_id, r.other_start_word, r.other_end_word) for r in got}
    assert both == {(d, e, f, a, b, c) for a, b, c, d, e, f in both}
    assert chaining.repeated_passages(none_of(spark, DOCS)).count() == 0


def test_align_single_is_align():
    rng = np.random.default_rng(31)
    rows = []
    for _ in range(400):
        a, b, size = (int(v) for v in (rng.integers(0, 65), rng.integers(0, 65), rng.integers(1, 40)))
        x = rng.integers(0, 3, a + size + int(rng.integers(0, 65))).astype(np.uint8)
        y = rng.integers(0, 3, b + size + int(rng.integers(0, 65))).astype(np.uint8)
        n = min(len(x) - a, len(y) - b)
        y[b:b + n] = np.where(rng.random(n) < 0.8, x[a:a + n], y[b:b + n])
        m = min(a, b)
        y[b - m:b] = np.where(rng.random(m) < 0.8, x[a - m:a], y[b - m:b])
        rows.append((x, y, a, b, size))
    want = [chaining.align(x, y, np.array([a]), np.array([b]), np.array([s])) for x, y, a, b, s in rows]
    cx, cy = (pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1))
    a, b, size = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
    for cut in (0, 7):  # also from within a longer column
        got = chaining.align_single(cx.slice(cut), cy.slice(cut), a[cut:], b[cut:], size[cut:])
        assert [[tuple(int(v) for v in row)] for row in zip(*got, strict=True)] == want[cut:]


def test_passages_whose_parts_stand_elsewhere(spark):
    rng = random.Random(23)
    shared = [words(rng, n).split() for n in (59, 80, 200)]
    rows = [(3 * k + i, " ".join(words(rng, 100).split() + own + words(rng, 100).split())) for k, own in enumerate(shared) for i in range(3)]
    whole = {k for k, _ in rows}
    for own in shared:
        for start in range(0, len(own) - 24, 5):
            rows += [(len(rows), " ".join(words(rng, 60).split() + own[start:start + 25] + words(rng, 60).split())) for _ in range(20)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == whole
    for k, own in enumerate(shared):
        for i in range(3):
            found = [r for r in got if r.doc_id == 3 * k + i]
            covered = {w for r in found for w in range(r.start_word, r.end_word)}
            assert covered >= set(range(100, 100 + len(own)))


def test_passages_meet_every_document_of_a_seed(spark):
    """Two edited passages, and a run of just 50 words, whose parts stand in 20 other documents each, and a copy of one of them."""
    rng = random.Random(29)
    edited, run = words(rng, 96).split(), words(rng, 50).split()
    other = [f"new{i}" if i % 16 == 8 else w for i, w in enumerate(edited)]
    rows = [(i, " ".join(words(rng, 90).split() + own + words(rng, 90).split())) for i, own in enumerate((edited, other, run, run))]
    rows.append((4, rows[3][1].upper()))
    for own in (edited, run):
        for start in range(0, len(own) - 24, 5):
            rows += [(len(rows) + i, " ".join(words(rng, 60).split() + own[start:start + 25] + words(rng, 60).split())) for i in range(20)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    met = {(r.doc_id, r.other_doc_id) for r in got}
    assert {(0, 1), (1, 0), (3, 4), (4, 3)} <= met and met & {(2, 3), (2, 4)} and {d for d, _ in met} <= {0, 1, 2, 3, 4}
    for doc in (0, 2, 3):
        covered = {w for r in got if r.doc_id == doc for w in range(r.start_word, r.end_word)}
        assert covered >= set(range(92, 138))


def test_blocks_of_a_seed_meet_once(spark):
    rows = [(doc, doc % 100, [1, 2], [doc, 500], [0, 0]) for doc in (*range(7), 103)]  # the last is a copy of the fourth
    texts = spark.createDataFrame(rows, "doc bigint, body bigint, hashes array<bigint>, places array<int>, spans array<int>")
    for block in (4, 1000):
        got = sorted((r.doc, r.other) for r in chaining.matches(texts, block).where("x = 500").collect())
        assert got == [(a, b) for a in range(7) for b in range(a)]


# pipeline


def test_pipeline_stages(spark, folder):
    names = [c.split()[0] for c in DOCS.split(", ")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    given = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34", "en", None, None)], DOCS))
    step = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == names
        ids = [r.doc_id for r in step.select("doc_id").collect()]
        if name == "language ID":
            assert sorted(ids) == sorted(before)
        elif name == "exact dedup":
            last = {t: max(i for i, u in before.items() if u == t) for t in before.values()}
            assert sorted(ids) == sorted(last.values())
        elif name == "near dedup":
            assert len(ids) == len(set(ids)) and set(ids) < set(last.values()) and len(ids) >= 0.9 * len(last)
            kept = set(ids)
        else:
            assert set(ids) <= kept
    packed = corpus_pipeline.STAGES[-1][1](spark, step, folder)
    assert set(r.doc_id for r in packed.select("doc_id").collect()) == set(ids)


def test_pipeline_on_odd_rows(spark, folder):
    for docs in (odd_documents(spark), none_of(spark, ODD)):
        step = docs
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, folder)
        step.count()
