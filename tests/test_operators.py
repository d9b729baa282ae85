"""Hand-made cases and random cases against plain restatements for the order-dependent operators."""

import random
import re
import statistics

from pyspark.sql import functions as F

from quireflow.operators import layout, merge, quality, shapes, structure, usage


def overlap(a, b):
    """Share of the lower one's height at which two fragments (.., y0, x1, y1) overlap."""
    return (min(a[5], b[5]) - max(a[3], b[3])) / min(a[5] - a[3], b[5] - b[3])


def test_lines_have_the_properties_of_lines(spark):
    rng = random.Random(3)
    frags = []
    for doc in range(40):
        for fid in range(rng.randint(1, 25)):
            y0 = float(rng.randint(0, 60))
            frags.append((doc, fid, float(rng.randint(0, 200)), y0, 0.0, y0 + rng.choice([6.0, 10.0, 18.0])))
    df = spark.createDataFrame(frags, "doc int, fid int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc, r.fid): r.line for r in layout.group_lines(df, ["doc"]).collect()}
    assert len(got) == len(frags)
    for doc in range(40):
        # by height of the middle; the first of a line stands for it
        own = sorted((f for f in frags if f[0] == doc), key=lambda f: ((f[3] + f[5]) / 2, f[2], f[1]))
        first = {}
        for f in own:
            first.setdefault(got[doc, f[1]], f)
        opened = {line: own.index(f) for line, f in first.items()}
        assert sorted(first) == list(range(1, len(first) + 1))
        for k, f in enumerate(own):
            line = got[doc, f[1]]
            open_before = sorted((n for n, at in opened.items() if at < k), key=opened.get)[-4:]
            fitting = [n for n in open_before if overlap(first[n], f) >= 0.5]
            assert line == fitting[-1] if fitting else first[line] is f


def test_line_ids_may_be_long(spark):
    df = spark.createDataFrame([(1, 5_000_000_000 + k, 10.0 * k, 0.0, 10.0 * k + 9, 10.0) for k in range(3)], "doc int, fid long, x0 double, y0 double, x1 double, y1 double")
    assert {r.fid: r.line for r in layout.group_lines(df, ["doc"]).collect()} == {5_000_000_000 + k: 1 for k in range(3)}


def test_drawn_spaces_and_icons(spark):
    rows = [(1, 0, "a", 0.0, 5.0, 10.0, False), (1, 1, " ", 5.0, 7.4, 10.0, False), (1, 2, "b", 7.4, 12.0, 10.0, False),
            (2, 0, "*", 0.0, 20.0, 20.0, True), (2, 1, "a", 20.0, 25.0, 10.0, False), (2, 2, "b", 25.0, 30.0, 10.0, False), (2, 3, " ", 31.0, 32.0, 10.0, False),
            (3, 0, " ", 0.0, 2.0, 10.0, False), (3, 1, "c", 2.0, 7.0, 10.0, False)]
    df = spark.createDataFrame([(*r[:5], 0.0, 10.0, *r[5:]) for r in rows], "line int, gno int, c string, x0 double, x1 double, y0 double, y1 double, size double, icon boolean")
    got = {r.line: (r.text, r.size, r.lead_size, r.trailing_space) for r in layout.build_lines(df, ["line"]).collect()}
    assert got == {1: ("a b", 10.0, 10.0, False), 2: ("*ab", 10.0, 10.0, True), 3: ("c", 10.0, 10.0, False)}


def test_cells_tile_the_grid(spark):
    rng = random.Random(5)
    slots, walls = [], {}
    for t in range(30):
        n_r, n_c = rng.randint(1, 5), rng.randint(1, 5)
        for r in range(n_r):
            for c in range(n_c):
                walls[t, r, c] = (rng.random() < 0.6, rng.random() < 0.6)
                slots.append((t, r, c, *walls[t, r, c]))
    df = spark.createDataFrame(slots, "t int, r int, c int, right boolean, below boolean")
    cover: dict[tuple, tuple] = {}
    cells = [(x.t, x.r, x.c, x.rs, x.cs) for x in shapes.grow_cells(df, ["t"]).collect()]
    for t, r, c, rs, cs in cells:
        for spot in ((t, i, k) for i in range(r, r + rs) for k in range(c, c + cs)):
            assert spot in walls and spot not in cover
            cover[spot] = (r, c)
    assert cover.keys() == walls.keys()

    def earlier(t, i, k, r, c):
        return cover[t, i, k] < (r, c)

    for t, r, c, rs, cs in cells:
        # nothing drawn between the slots of its top row, nor under any of its rows but the last
        assert not any(walls[t, r, k][0] for k in range(c, c + cs - 1))
        assert not any(walls[t, i, k][1] for i in range(r, r + rs - 1) for k in range(c, c + cs))
        # as wide, then as tall, as walls, the edge and earlier cells allow
        assert (t, r, c + cs) not in walls or walls[t, r, c + cs - 1][0] or earlier(t, r, c + cs, r, c)
        low = r + rs
        assert (t, low, c) not in walls or any(walls[t, low - 1, k][1] or earlier(t, low, k, r, c) for k in range(c, c + cs))


def test_boxes_and_strokes_never_share_a_number(spark):
    boxes = spark.createDataFrame([(1, 1, 1_000_001, 0.0, 0.0, 50.0, 50.0), (1, 1, 7, 150.0, 0.0, 200.0, 50.0), (1, 1, 8, 400.0, 400.0, 450.0, 450.0)],
                                  "doc_id long, page int, box long, x0 double, y0 double, x1 double, y1 double")
    strokes = spark.createDataFrame([(1, 1, 1, 50.0, 25.0, 150.0, 25.0)], "doc_id long, page int, seg long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.boxes, r.x0, r.x1) for r in shapes.linked_boxes(boxes, strokes).collect()] == [(2, -2.0, 202.0)]


def test_chart_labels(spark):
    images = spark.createDataFrame([(1, 1, 1, 100.0, 100.0, 200.0, 200.0)], "doc_id long, page int, img long, x0 double, y0 double, x1 double, y1 double")
    frags = spark.createDataFrame(
        [(1, 1, 1, "A", 1, 120.0, 120.0, 130.0, 130.0, 10.0), (1, 1, 2, "100", 3, 205.0, 150.0, 220.0, 160.0, 10.0), (1, 1, 3, "a long line", 11, 400.0, 120.0, 500.0, 130.0, 10.0),
         (1, 1, 4, "far", 3, 300.0, 300.0, 320.0, 310.0, 10.0)],
        "doc_id long, page int, fid long, text string, chars int, x0 double, y0 double, x1 double, y1 double, size double")
    got = {r.frag for r in shapes.absorb_labels(images, frags).collect()}
    assert got == {1, 2}


def test_chart_labels_spread_and_stop(spark):
    images = spark.createDataFrame([(1, 1, 3, 100.0, 100.0, 200.0, 200.0), (1, 1, 4, 100.0, 400.0, 200.0, 500.0), (1, 1, 5, 300.0, 400.0, 310.0, 410.0)],
                                   "doc_id long, page int, img long, x0 double, y0 double, x1 double, y1 double")
    texts = [(1, "A", 120, 120, 10), (2, "10", 205, 150, 10), (3, "20", 228, 150, 10),  # a chain to the right, four letters in all
             (4, "abcde", 100, 210, 30), (5, "fghij", 135, 210, 30),  # a row of ten letters under it: running text
             (6, "z", 215, 190, 5), (7, "a whole line", 240, 190, 80),  # beside a longer text of its height, away from the picture
             (8, "x", 120, 450, 10), (9, "far", 400, 450, 15), (10, "on it", 301, 401, 5)]
    frags = spark.createDataFrame([(1, 1, i, t, len(t), float(x), float(y), float(x + w), float(y + 10), 10.0) for i, t, x, y, w in texts],
                                  "doc_id long, page int, fid long, text string, chars int, x0 double, y0 double, x1 double, y1 double, size double")
    got = {r.frag: r.image for r in shapes.absorb_labels(images, frags).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 6: 3, 8: 4}


def test_merge_of_two_documents(spark):
    rows = [(1, 0, i, "question", i, 1) for i in (1, 2, 3)] + [(1, 1, i, "question", i, 1) for i in (13, 14)] + [(1, 1, 9, "answer", 14, None)]
    df = spark.createDataFrame(rows, "bundle int, file_ord int, ord int, kind string, number int, passage_id int")
    got = sorted((r.file_ord, r.kind, r.new_number) for r in merge.merge_docs(df).collect())
    assert got == [(0, "question", 1), (0, "question", 2), (0, "question", 3), (1, "answer", 5), (1, "question", 4), (1, "question", 5)]
    guide = spark.range(1).select(merge.shift_ranges(F.lit("[1~2] 다음 [ 3 - 4 ]"), F.lit(3)).alias("t")).first().t
    assert guide == "[4~5] 다음 [ 6 - 7 ]"


def test_gap_document_notes(spark):
    q = spark.createDataFrame([(1, i, 0, n) for i, n in enumerate((1, 2, 3, 4, 9))], "doc_id long, ord int, chunk int, number int")
    a = spark.createDataFrame([(1, i, n) for i, n in enumerate((1, 3, 4, 5))], "doc_id long, ord int, number int")
    auto = sorted((r.note, r.placeholder) for r in merge.plan_notes(q, a).collect())
    assert auto == [(1, False), (2, True), (3, False), (4, False), (5, True)]
    literal = sorted((r.note, r.restart) for r in merge.plan_notes(q, a, auto=False).collect())
    assert literal == [(1, False), (3, True), (4, False)]
    assert [r.number for r in merge.leftover_answers(q, a).collect()] == [5]


def test_number_chains_of_short_documents_take_no_rounds(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(d, i, i // 7, rng.randint(1, 9), rng.random() < 0.4) for d in range(25) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "doc_id long, ord int, chunk int, number int, big boolean")
    faithful = spark.createDataFrame([(d, d % 2 == 0) for d in range(20)], "doc_id long, faithful boolean")
    find = lambda: sorted(map(tuple, structure.scan_headers(df, faithful=faithful).collect()))
    for limit in (0, 12):  # all documents, or the longer ones alone, along pointers
        monkeypatch.setattr(structure, "FOLD", limit)
        got = find()
        assert got
        if limit:
            assert got == want
        want = got
    monkeypatch.undo()
    monkeypatch.setattr(structure.graph, "follow_chain", None)
    assert find() == want


def test_words_are_looked_up_in_order_without_rows_of_prefixes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abß으") for _ in range(rng.randint(1, 4)))
    vocab = [(d, word()) for d in (1, 2, None) for _ in range(12)]
    pairs = [(d, i, word(), word()) for d in (1, 2, 3, None) for i in range(60)] * 2
    have = {w for d, w in vocab if d == 1}, {w for d, w in vocab if d == 2}

    def space(d, w1, w2):
        words = have[d - 1] if d in (1, 2) else set()
        starts = lambda w: any(v.startswith(w) for v in words)
        return not starts(w1 + w2) and not w2.startswith("으") and w1 in words and starts(w2)

    asked = spark.createDataFrame(pairs, "doc_id long, ord int, w1 string, w2 string")
    found = layout.line_end_space(asked, spark.createDataFrame(vocab, "doc_id long, word string"))
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((*p, space(p[0], *p[2:])) for p in pairs), key=key)
    assert any(r.space for r in found.collect())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_meet_by_the_half_that_is_alike(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))
    vocab = [(d, w, rng.randint(2, 4)) for d in (1, 2) for w in {word() for _ in range(25)}]
    asked = [(d, word()) for d in (1, 2, 3) for _ in range(60)]
    want = set()
    for d, w in asked:
        if not any(e == d and v.startswith(w) for e, v, _ in vocab):
            near = [v for e, v, n in vocab if e == d and n >= 3 and len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1]
            want |= {(d, w, near[0])} if len(near) == 1 else set()
    found = layout.vocab_fix(spark.createDataFrame(asked, "doc_id long, word string"), spark.createDataFrame(vocab, "doc_id long, word string, n long"), F.lit(True))
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    assert not any("key#" in line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line)


def test_headers_follow_big_jumps(spark):
    rows = [(1, 1, 0, 1, False), (1, 2, 0, 4, False), (1, 3, 0, 2, False), (1, 4, 0, 4, True), (1, 5, 0, 5, False)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, chunk int, number int, big boolean")
    got = sorted((r.ord, r.number, r.skipped) for r in structure.scan_headers(df).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (4, 4, 1), (5, 5, 0)]


def test_coverage_of_short_and_empty_texts(spark):
    src = spark.createDataFrame([(1, "abcdefgh"), (2, "abc"), (3, "hello world")], "pair long, text string")
    out = spark.createDataFrame([(1, "abcdefgh"), (3, "hello wo there")], "pair long, text string")
    got = {r.pair: r.coverage for r in quality.coverage(src, out).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.4}


def test_retention_keeps_newest_prefix(spark):
    rng = random.Random(9)
    rows = [(f"k{i}", rng.randint(0, 20) * 43200 + i, rng.randint(1, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts long, size long")
    now = 20 * 43200 + 300
    got = {r.key for r in usage.prune_samples(df, now, 7, 25, 500).collect()}
    kept, total = set(), 0
    for key, ts, size in sorted((r for r in rows if now - r[1] <= 7 * 86400), key=lambda r: (r[1], r[0]), reverse=True):
        total += size
        if len(kept) + 1 > 25 or total > 500:
            break
        kept.add(key)
    assert got == kept


def test_order_of_questions_in_the_output(spark):
    paras = {1: "3. a|x|4 . b|5. c", 2: "3. a|5. c", 3: "4. b|3. a|5. c", 4: "no question", 5: "no question", 6: "3. a|5. b", 7: "3. a|4. b|5. c|6. d", 8: "1. a|2. b"}
    asked = {1: [3, 4, 5], 2: [3, 4, 5], 3: [3, 4, 5], 6: [3, 5], 7: [3, 4, 5], 8: [2, 1]}
    numbers = spark.createDataFrame([(d, o, 0, n) for d, own in asked.items() for o, n in enumerate(own)], "doc_id int, ord int, chunk int, number int")
    texts = spark.createDataFrame([(d, o, 0, t) for d, own in paras.items() for o, t in enumerate(own.split("|"))], "doc_id int, ord int, chunk int, text string")
    answers = spark.createDataFrame([(5,)], "doc_id int")
    got = {r.doc_id: (r.questions, r.found, r.status) for r in quality.order_status(numbers, texts, answers).collect()}
    assert got == {1: (3, 3, "PASS"), 2: (3, 1, "FAIL"), 3: (3, 1, "FAIL"), 4: (0, 0, "WARN"), 5: (0, 0, "FAIL"), 6: (2, 1, "FAIL"), 7: (3, 3, "PASS"), 8: (2, 1, "FAIL")}


def test_primitives_under_their_schemas(spark, tmp_path):
    from quireflow.sources import tables

    root = str(tmp_path)
    spark.createDataFrame([(1, 1, 0, 0, "a", 1.0, 2.0, 3.0, 4.0, 10.0, "f", 0, 0, 0, None, None, 0.1)], tables.PRIMITIVES["glyphs"]).write.parquet(f"{root}/glyphs")
    spark.createDataFrame([(1, 1, 0, 0, "l", 0.0, 0.0, 9.0, 0.0, 1.0, "s", [0.0], None, 1.0)], tables.PRIMITIVES["paths"]).write.parquet(f"{root}/paths")
    spark.createDataFrame([(1, 1, None, 0.0, 0.0, 9.0, 9.0, "d", False, [0.5])], tables.PRIMITIVES["images"]).write.parquet(f"{root}/images")
    spark.createDataFrame([(1, 1, 595.0, 842.0), (1, 1, 595.0, 842.0)], tables.PRIMITIVES["pages"]).write.parquet(f"{root}/pages")
    loaded = tables.load_primitives(spark, root)
    assert {name: df.count() for name, df in loaded.items()} == {"glyphs": 1, "paths": 1, "images": 1, "pages": 2}
    assert loaded["glyphs"].first().c == "a" and loaded["paths"].first().stroke == [0.0]
    found = {r.table_name: (r.null_keys, r.repeated_keys) for r in tables.key_violations(loaded).collect()}
    assert found == {"glyphs": (0, 0), "paths": (0, 0), "images": (1, 0), "pages": (0, 1)}


def test_presets_listed(spark, tmp_path):
    import json

    from quireflow.sources import tables

    (tmp_path / "b-second.json").write_text(json.dumps({"name": "Second", "fonts": ["x", "y"], "runs": {"a": 1}}, indent=1))
    (tmp_path / "a-first.json").write_text(json.dumps({"fonts": []}))
    rows = [(r.id, r.name, r.fonts) for r in tables.list_presets(spark, str(tmp_path)).collect()]
    assert rows == [("a-first", "a-first", []), ("b-second", "Second", ["x", "y"])]


def test_usage_appended(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    from quireflow.operators import usage as ops
    from quireflow.sources import corpus

    log = corpus.usage(spark, folder).withColumn("user", F.when(F.col("id") % 7 == 0, "  ").otherwise(F.col("user")))
    path = str(tmp_path / "log")
    ops.append_usage(log.where("id % 2 = 0"), path)
    ops.append_usage(log.where("id % 2 = 1"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == log.count() and stored.where("user = '?'").count() == log.where("id % 7 = 0").count()
    assert stored.where("date <> to_date(ts)").count() == 0 and stored.where("abs(seconds * 100 - rint(seconds * 100)) > 1e-6").count() == 0


def test_tables_end_in_a_short_plan(spark):
    cells = [(1, 1, 50.0 + 30 * c, 100.0, 50.0 + 30 * c, 140.0) for c in range(3)] + [(1, 1, 50.0, 100.0 + 20 * r, 110.0, 100.0 + 20 * r) for r in range(3)]
    found = shapes.detect_tables(spark.createDataFrame(cells, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"))
    assert found.count() == 4
    # lines, grids and grown cells are read from files, not planned again for each step that reads them
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_a_page_are_found_in_its_row(spark, monkeypatch):
    """Two tables on a page, one whose upper right cell is joined and whose last rule stands 1.5 points outside, without rounds over tables."""
    strokes = [(50.0 + 30 * c, 100.0, 50.0 + 30 * c, 140.0) for c in (0, 1)] + [(110.0, 120.0, 110.0, 140.0), (141.5, 100.0, 141.5, 140.0)]
    strokes += [(50.0, 100.0 + 20 * r, 140.0, 100.0 + 20 * r) for r in range(3)]
    strokes += [(300.0 + 30 * c, 400.0, 300.0 + 30 * c, 420.0) for c in range(4)] + [(300.0, 400.0 + 20 * r, 390.0, 400.0 + 20 * r) for r in range(2)]
    strokes += [(300.0, 600.0, 390.0, 600.0), (450.0, 600.0, 450.0, 640.0)]
    rows = [(doc, 1, *s) for doc in (1, 2) for s in strokes]
    settled = []
    for module in (shapes, shapes.graph):
        monkeypatch.setattr(module, "settle", lambda df, real=shapes.settle: settled.append(df) or real(df))
    found = shapes.detect_tables(spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"))
    want = [(0, 0, 1, 1, 50, 80), (0, 1, 1, 2, 80, 141.5), (1, 0, 1, 1, 50, 80), (1, 1, 1, 1, 80, 110), (1, 2, 1, 1, 110, 141.5)]
    want += [(0, c, 1, 1, 300 + 30 * c, 330 + 30 * c) for c in range(3)]
    got = [(r.doc_id, r.row, r.col, r.rowspan, r.colspan, r.x0, r.x1) for r in found.collect()]
    assert sorted(got) == sorted((doc, *cell) for doc in (1, 2) for cell in want)
    assert len(settled) <= 3


def test_captions_that_stick_out_lie_in_other_cells(spark):
    # the first text ends left of the picture and of the cell border at 96
    images = spark.createDataFrame([(1, 1, 5, 97.0, 10.0, 160.0, 50.0)], "doc_id long, page int, img int, x0 double, y0 double, x1 double, y1 double")
    frags = spark.createDataFrame([(1, 1, 1, "<", 12.0, 86.0, 55.0, 94.0, 65.0), (1, 1, 2, "a>", 12.0, 100.0, 55.0, 120.0, 65.0)],
                                  "doc_id long, page int, fid int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    assert {(r.frag, r.image) for r in shapes.captions(images, frags).collect()} == {(1, 5), (2, 5)}


def test_glyphs_meet_their_row_without_a_shuffle(spark, folder):
    from quireflow.sources import corpus

    glyphs = corpus.glyphs(spark, folder).withColumn("icon", F.lit(False))
    lines = layout.build_lines(glyphs, ["doc_id", "page", "frag"])
    rows = corpus.layout_rows(spark, folder)
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (rows, lines)]
    assert shuffles[1] == shuffles[0]


def test_coverage_shuffles_texts_and_not_shingles(spark, monkeypatch):
    rng = random.Random(8)
    lines = [(pair, no, 1, "".join(rng.choice("ab 1") for _ in range(rng.randint(0, 30)))) for pair in range(12) for no in range(1 + 3 * pair)]
    kept = {pair: " ".join(t for p, no, _, t in lines if p == pair and no % 3) for pair in range(12)}
    source = spark.createDataFrame(lines, "pair long, line_no int, page int, text string")
    output = spark.createDataFrame(list(kept.items()), "pair long, text string")

    def parts(text):
        text = text.replace(" ", "")
        return {text[k:k + 6] for k in range(len(text) - 5)}

    shares, missing = {}, set()
    for pair, text in kept.items():
        own = set().union(*(parts(t) for p, _, _, t in lines if p == pair))
        found = parts(text)
        shares[pair] = (round(len(own & found) / max(1, len(own)), 4), round(len(own & found) / max(1, len(found)), 4))
        missing |= {(p, no) for p, no, _, t in lines if p == pair and 2 * len(parts(t) & found) < len(parts(t))}
    for chars in (1 << 20, 200):  # all pairs are dealt by pair, or the longer ones are not
        monkeypatch.setattr(quality, "PAIR_CHARS", chars)
        assert {r.pair: (r.coverage, r.precision) for r in quality.coverage(source, output).collect()} == shares
        assert {(r.pair, r.line_no) for r in quality.missing_lines(source, output).collect()} == missing
    for df in (quality.coverage(source, output), quality.missing_lines(source, output)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Generate") == 4


def test_lines_of_the_source_are_not_shuffled_before_they_are_dealt(spark, folder, monkeypatch):
    from quireflow.plans import quality_queries

    plans, real = [], quality_queries.settle
    monkeypatch.setattr(quality_queries, "settle", lambda df: plans.append(plan_of(df)) or real(df))
    source, output = quality_queries.source_and_output(spark, folder)
    assert sum("Exchange" not in plan for plan in plans) == 1  # the lines as they are read
    assert not any("SortMergeJoin" in plan for plan in plans)
    plan = plan_of(quality.missing_lines(source, output))
    assert "Window" not in plan and "ShuffledHashJoin" in plan


def test_passages_meet_a_few_shingles_without_a_shuffle_of_all(spark, monkeypatch):
    items = spark.createDataFrame([(1, "abcdefghij")], "item long, text string")
    outputs = spark.createDataFrame([(k, "xx abcdefghij " * 3) for k in range(4)], "pair long, text string")
    plans = []
    monkeypatch.setattr(quality, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert {(r.pair, r.hits) for r in quality.passage_coverage(items, outputs).collect()} == {(k, 5) for k in range(4)}
    assert "rightHint=(strategy=broadcast)" in plans[-1]


def test_passages_are_counted_where_their_texts_are(spark, monkeypatch):
    """No shingle is shuffled, and nothing is joined with all shingles of an item once more; outputs in several rows are one."""
    rng = random.Random(19)
    texts = {k: "".join(rng.choice("abc") for _ in range(400)) for k in range(12)}
    items = [(k, texts[k][at:at + 60]) for k in range(12) for at in (0, 200)] + [(99, "abcab")]
    rows = [(k, texts[k][:250]) for k in texts] + [(k, texts[k][150:]) for k in range(6)] + [(70, None), (71, "ab")]
    items, outputs = spark.createDataFrame(items, "item long, text string"), spark.createDataFrame(rows, "pair long, text string")
    pieces = lambda text: {text[k:k + 6] for k in range(len(text or "") - 5)}
    wanted, held = {}, {}
    for rows_, sets in ((items.collect(), wanted), (outputs.collect(), held)):
        for key, text in rows_:
            sets.setdefault(key, set()).update(pieces(text))
    want = {(i, p, len(a & b)) for i, a in wanted.items() for p, b in held.items() if a and len(a & b) >= 0.5 * len(a)}
    real = quality.settle
    for limit in (1 << 20, 500):  # then texts of over 500 characters are dealt by shingle
        plans = []
        monkeypatch.setattr(quality, "PAIR_CHARS", limit)
        monkeypatch.setattr(quality, "settle", lambda df: plans.append(plan_of(df)) or real(df))
        found = quality.passage_coverage(items, outputs)
        assert {(r.item, r.pair, r.hits) for r in found.collect()} == want
        shuffled = re.findall(r"Exchange hashpartitioning\((?:pair#\d+L, shingle#\d+|shingle#\d+, pair#\d+L)", "\n".join([*plans, plan_of(found)]))
        assert len(shuffled) == 1 and plans[-1].count("REPARTITION_BY_NUM") == 1  # of the large pairs, and the texts of the others


def test_overprint_is_folded_by_row(spark):
    from quireflow.operators import cleanup

    rng = random.Random(41)
    rows = [(1, page, frag, gno, rng.choice(["a", "a", "b", None]), rng.choice([0.0, 1.0, 2.5, 4.0, 9.0]), 10.0)
            for page in (1, 2) for frag in range(40) for gno in range(rng.randint(1, 12))]
    want = []
    for key in sorted({r[:3] for r in rows}):
        last = None
        for r in sorted((r for r in rows if r[:3] == key), key=lambda r: r[3]):
            if last is None or None in (r[4], last[4]) or r[4] != last[4] or not abs(r[5] - last[5]) < 3.0:
                want.append(r)
                last = r
    found = cleanup.dedupe_overprint(spark.createDataFrame(rows, "doc_id long, page int, frag int, gno int, c string, x0 double, size double"))
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted(r[:4] for r in want)
    assert "Window" not in plan_of(found)


def test_letters_of_dealt_runs_are_not_shuffled(spark):
    runs = [(doc, stem, k, t, "A", lined and k == 2) for doc, lined in ((1, True), (2, False)) for stem in (1, 2) for k, t in ((1, "옳지 "), (2, "않"), (3, " 은 것은?"))]
    dealt = spark.createDataFrame(runs, "doc_id long, stem int, run int, text string, look string, underline boolean").repartition(3, "doc_id")
    out = structure.underline_runs(dealt)
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")
    got = {(r.doc_id, r.stem): [] for r in dealt.collect()}
    for r in sorted(out.collect(), key=lambda r: r.run):
        got[r.doc_id, r.stem].append((r.text, r.underline))
    assert got[1, 1] == got[1, 2] == [("옳지 ", False), ("않은", True), (" 것은?", False)]
    assert "".join(t for t, _ in got[2, 1]) == "옳지 않 은 것은?"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_glyphs_of_fragments_are_counted_by_size(spark):
    rng = random.Random(5)
    rows = [(1, page, frag, rng.choice("ab \t"), float(k), float(k % 7), k + 5.0, k + 9.0, rng.choice([8.0, 9.0, 10.0, 12.0])) for page in (1, 2) for frag in range(9) for k in range(frag)]
    glyphs = spark.createDataFrame(rows, "doc_id long, page int, frag int, c string, x0 double, y0 double, x1 double, y1 double, size double")
    out = layout.frags(glyphs)
    want = {}
    for r in rows:
        if r[3] not in " \t":
            want.setdefault(r[1:3], []).append(r)
    assert {(r.page, r.frag): (r.x0, r.y0, r.x1, r.y1, r["size"], r.glyphs) for r in out.collect()} == {
        k: (min(r[4] for r in v), min(r[5] for r in v), max(r[6] for r in v), max(r[7] for r in v), statistics.median(r[8] for r in v), len(v)) for k, v in want.items()}
    assert re.search(r" HashAggregate\(keys=\[doc_id#\d+L, page#\d+, frag#\d+, \S*size", plan_of(out)) and "median" not in plan_of(out)


def test_lines_are_grouped_without_a_join_or_a_frame_to_the_end(spark):
    df = spark.createDataFrame([(1, k, 1.0 * k, 10.0 * (k // 3) + k % 2, 1.0 * k + 1, 10.0 * (k // 3) + 9, f"t{k}") for k in range(9)],
                               "doc int, fid int, x0 double, y0 double, x1 double, y1 double, text string")
    out = layout.group_lines(df, ["doc"])
    assert out.columns == [*df.columns, "line"]
    assert {(r.fid, r.text, r.line) for r in out.collect()} == {(k, f"t{k}", k // 3 + 1) for k in range(9)}
    assert "Join" not in plan_of(out) and "unboundedfollowing" not in plan_of(out)


def test_parts_of_cut_lines_look_once_at_each_glyph(spark):
    row = (1, 4, [(c, 5.0 * k, 5.0 * k + 5) for k, c in enumerate(" ab  cd")])
    lines = spark.createDataFrame([row, (2, None, row[2]), (3, 1, row[2])], "ord int, cut int, glyphs array<struct<c:string,x0:double,x1:double>>")
    out = structure.cut_lines(lines)
    assert sorted((r.ord, r.part, r.text, r.x0, r.x1) for r in out.collect()) == [
        (1, 0, "ab", 5.0, 15.0), (1, 1, "cd", 25.0, 35.0), (2, 0, "ab  cd", 5.0, 35.0), (3, 1, "ab  cd", 5.0, 35.0)]
    assert len(re.findall(r"filter\(", plan_of(out))) == 1 and "array_join(transform" not in plan_of(out)


def test_words_of_dealt_rows_stay_where_their_page_is(spark, folder):
    from __spark_entry__ import load_queries
    from quireflow.sources import corpus

    dealt = plan_of(corpus.layout_rows(spark, folder)).count("Exchange")
    for name in ("clean_runs", "far_fragments_split"):
        assert plan_of(load_queries()[name].run(spark, folder)).count("Exchange") == dealt, name


def test_far_pieces_are_put_together_beside_their_fragments(spark):
    words = [(1, 1, "한글", 0.0, 10.0), (1, 2, "나", 60.0, 70.0), (2, 1, "한글입니다", 0.0, 30.0), (2, 2, "-나", 90.0, 99.0), (3, 1, "아주 긴 조각", 0.0, 30.0), (3, 2, "b", 90.0, 99.0),
             (4, 1, "a", 0.0, 5.0), (4, 2, None, 50.0, 55.0), (4, 3, "c", 100.0, 105.0), (5, 1, "[A]", 0.0, 10.0), (5, 2, "b", 20.0, 30.0)]
    frags = spark.createDataFrame([(*w, 10.0, False) for w in words], "line int, fid int, text string, x0 double, x1 double, size double, icon boolean")
    out = layout.split_far(frags, ["line"])
    assert "Join" not in plan_of(out) and out.columns == [*frags.columns, "piece"]
    got = {(r.line, r.fid): r.piece for r in out.collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 0, (2, 2): 1, (3, 1): 0, (3, 2): 1, (4, 1): 0, (4, 2): 0, (4, 3): 0, (5, 1): 0, (5, 2): 1}


def test_fonts_go_back_to_their_pages_and_glyphs_stay(spark, folder):
    from quireflow.functions import text as tx
    from quireflow.sources import corpus

    glyphs = corpus.glyphs(spark, folder).withColumn("bold", tx.is_bold(F.col("font"), F.col("flags"), F.col("char_flags")))
    assert len(re.findall(r"hashpartitioning\(doc_id#\d+L, font", plan_of(layout.plain_strokes(glyphs)))) == 1
    # 48 of 60 glyphs of one font on two pages are stroked, too few of the font; of the other 30 and 30
    rows = [(1, page, font, "a", 48 if k % 5 or font == "B" else 0, 0) for font in "AB" for page in (1, 2) for k in range(30)]
    few = spark.createDataFrame(rows, "doc_id long, page int, font string, c string, char_flags int, flags int").withColumn("bold", F.col("char_flags") == 48)
    assert {(r.font, r.bold): r["count"] for r in layout.plain_strokes(few).groupBy("font", "bold").count().collect()} == {("A", True): 48, ("A", False): 12, ("B", False): 60}


def test_glyphs_of_dealt_items_are_not_shuffled_by_line(spark, folder):
    from __spark_entry__ import load_queries

    for name in ("label_blanks_underlined", "bracket_labels_split"):
        plan = plan_of(load_queries()[name].run(spark, folder))
        assert re.search(r"hashpartitioning\(doc_id#\d+L, \d+\), REPARTITION_BY_NUM", plan), name
        # strokes that fit are found by line; glyphs are not dealt by it
        assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L, page#\d+, line#\d+, gno", plan), name


def test_questions_are_put_together_once(spark):
    flags = "mark boolean, part boolean, far boolean, p_full boolean, sub boolean, writes boolean, credit boolean"
    rows = [(1, 1, k, "line", k > 1, *[False] * 6, 1 + k // 8, True) for k in range(1, 9)]
    items = spark.createDataFrame(rows, f"question int, chunk int, ord int, kind string, {flags}, page int, last boolean")
    out = structure.behind_last(structure.assemble_questions(items))
    assert "ExistingRDD" not in plan_of(out) and plan_of(out).count("Exchange") <= 4
    assert {(r.ord, r.state, r.dropped) for r in out.collect()} == {(1, "stem", False), *((k, "choices", k == 8) for k in range(2, 9))}
