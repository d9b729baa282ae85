"""Lines, columns and reading order over whole documents."""

from pyspark.sql import functions as F

from quireflow.functions import text as tx
from quireflow.operators import layout as ops
from quireflow.plans.registry import query, sql_view
from quireflow.plans.structure_queries import text_lines
from quireflow.sources import corpus
from quireflow.sources.corpus import table


@query("fragments", "C1", """
SELECT doc_id, page, row_no AS frag, x0, y0, x1, y1, size, CAST(length(replace(text, ' ', '')) AS BIGINT) AS glyphs FROM layout_rows""", ("layout_rows",))
def _(spark, folder):
    return ops.frags(corpus.glyphs(spark, folder))


@query("plain_strokes", "C2", """
WITH g AS (SELECT doc_id, frag, gno, c, font, CASE WHEN doc_id % 3 = 0 THEN 48 ELSE char_flags END AS cf, flags FROM glyphs),
p AS (SELECT doc_id, font FROM g GROUP BY ALL HAVING count(*) >= 50 AND count(*) FILTER ((cf & 48) = 48) >= 0.85 * count(*))
SELECT g.doc_id, count(*) FILTER (CASE WHEN lower(g.font) LIKE '%semibold%' THEN (cf & 48) = 48 ELSE lower(g.font) LIKE '%bold%' OR (flags & 16) <> 0 OR regexp_matches(g.font, '[a-z](EB|XB|B)$') OR (cf & 48) = 48 END
   AND NOT (p.font IS NOT NULL AND (cf & 48) = 48 AND NOT CASE WHEN lower(g.font) LIKE '%semibold%' THEN false ELSE lower(g.font) LIKE '%bold%' OR (flags & 16) <> 0 OR regexp_matches(g.font, '[a-z](EB|XB|B)$') END)) AS bold
FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.font = g.font GROUP BY g.doc_id""", ("glyphs",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder).withColumn("char_flags", F.when(F.col("doc_id") % 3 == 0, 48).otherwise(F.col("char_flags")))
    g = g.withColumn("bold", tx.is_bold(F.col("font"), F.col("flags"), F.col("char_flags")))
    return ops.plain_strokes(g).groupBy("doc_id").agg(F.count_if("bold").alias("bold"))


def page_frags(spark, folder):
    rows = corpus.layout_rows(spark, folder)
    frags = rows.select("doc_id", "page", F.col("row_no").alias("frag"), "text", "x0", "y0", "x1", "y1", "size")
    pages = rows.groupBy("doc_id", "page").agg(F.lit(842.0).alias("height"), F.lit(80.0).alias("top"), F.lit(610.0).alias("bottom"))
    return frags, pages


sql_view("page_frags", r"""
SELECT doc_id, page, row_no AS frag, text, y0, y1, size, y1 <= 0.12 * 842 OR y0 >= 0.88 * 842 AS outer_band, (y0 + y1) / 2 <= 80 OR (y0 + y1) / 2 >= 610 AS banded,
       regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '#', 'g') AS key, CAST(round_even(y0 / 3, 0) AS INTEGER) AS row FROM layout_rows""", ("layout_rows",))


@query("repeated_headers_dropped", "C10", r"""
SELECT f.doc_id, f.page, f.frag FROM page_frags f
LEFT JOIN (SELECT c.doc_id, key, row FROM (SELECT doc_id, key, row, count(*) AS n FROM page_frags WHERE outer_band GROUP BY ALL) c
           JOIN (SELECT doc_id, greatest(2, floor(count(DISTINCT page) * 0.4)) AS need FROM page_frags GROUP BY doc_id) p ON p.doc_id = c.doc_id
           WHERE n >= need AND length(regexp_replace(key, '[^\p{L}\p{N}_]', '', 'g')) >= 3 AND key NOT LIKE '※%') r
ON r.doc_id = f.doc_id AND r.key = f.key AND r.row = f.row
WHERE NOT banded AND NOT (outer_band AND (r.key IS NOT NULL OR regexp_full_match(trim(text), '-\s*\d+\s*-')))""", ("page_frags",))
def _(spark, folder):
    kept, _ = ops.drop_repeated(*page_frags(spark, folder))
    return kept.select("doc_id", "page", "frag")


@query("header_texts", "C10", """SELECT doc_id, page, trim(text) AS text, size, y0 FROM page_frags WHERE banded""", ("page_frags",))
def _(spark, folder):
    return ops.drop_repeated(*page_frags(spark, folder))[1]


@query("repeated_source_lines", "C10 B8", r"""
SELECT source, key, n FROM (SELECT source, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '#', 'g') AS key, count(DISTINCT doc_id) AS n FROM doc_lines GROUP BY ALL)
WHERE n >= 2 AND length(regexp_replace(key, '[^\p{L}\p{N}_]', '', 'g')) >= 3""", ("doc_lines",))
def _(spark, folder):
    # lines repeated across the documents of a source: a (source, key, document) row first, so a hot line combines early
    lines = corpus.doc_lines(spark, folder).select("source", tx.norm_repeat("text").alias("key"), "doc_id").distinct()
    counts = lines.groupBy("source", "key").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= 2) & (F.length(F.regexp_replace("key", r"[#]|[^\p{L}\p{N}_]", "")) >= 3))


def word_frags(spark, folder):
    return corpus.words(spark, folder).withColumn("fid", F.col("row_no").cast("long") * 1_000_000 + F.col("word_no"))


@query("fragments_grouped", "C13", """
SELECT doc_id, page, col, row_no * 1000000 + word_no AS fid, CAST(dense_rank() OVER (PARTITION BY doc_id, page, col ORDER BY row_no) AS INTEGER) AS line FROM words""", ("words",))
def _(spark, folder):
    return ops.group_lines(word_frags(spark, folder), ["doc_id", "page", "col"]).select("doc_id", "page", "col", "fid", "line")


@query("far_fragments_split", "C14", """
WITH g AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY doc_id, row_no ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3 * 10 THEN 1 ELSE 0 END AS cut FROM words),
p AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, row_no ORDER BY x0) AS piece FROM g),
j AS (SELECT doc_id, row_no FROM (SELECT doc_id, row_no, piece, string_agg(text, '' ORDER BY x0) AS t FROM p GROUP BY ALL) GROUP BY ALL
      HAVING count(*) >= 2 AND max(length(t)) <= CASE WHEN count(*) >= 3 THEN 12 ELSE 6 END AND NOT bool_or(t LIKE '-%'))
SELECT p.doc_id, p.row_no, p.word_no, CAST(CASE WHEN j.doc_id IS NOT NULL THEN 0 ELSE piece END AS BIGINT) AS piece FROM p LEFT JOIN j ON j.doc_id = p.doc_id AND j.row_no = p.row_no""", ("words",))
def _(spark, folder):
    w = word_frags(spark, folder).withColumns({"icon": F.lit(False), "size": F.lit(10.0)})
    return ops.split_far(w, ["doc_id", "page", "row_no"]).select("doc_id", "row_no", "word_no", F.col("piece").cast("long"))


@query("lines_built", "C15", """
SELECT doc_id, page, row_no AS frag, trim(text) AS text, x0, x1, size, size AS lead_size, false AS trailing_space FROM layout_rows""", ("layout_rows",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder).withColumn("icon", F.lit(False))
    return ops.build_lines(g, ["doc_id", "page", "frag"]).drop("y0", "y1")


@query("wide_gaps_kept", "C15", """
SELECT doc_id, CASE WHEN l_quantity > 30 THEN 'ab' || repeat(' ', CAST(least(12, greatest(1, round_even(l_quantity / 10, 0) - 2)) AS INTEGER)) || ' cd'
       WHEN l_quantity > 2.5 THEN 'ab cd' ELSE 'abcd' END AS text, ord FROM numbers""".replace("repeat(' '", "repeat(chr(8195)"), ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder).select("doc_id", "ord", "l_quantity", F.posexplode(F.split(F.lit("abcd"), "")).alias("gno", "c"))
    x0 = F.col("gno") * 5.0 + F.when(F.col("gno") >= 2, F.col("l_quantity")).otherwise(0)
    g = n.select("doc_id", "ord", "gno", "c", x0.alias("x0"), (x0 + 5).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), F.lit(10.0).alias("size"), F.lit(False).alias("icon"))
    return ops.build_lines(g, ["doc_id", "ord"]).select("doc_id", "ord", "text")


@query("drawn_spaces_kept", "C15", """
SELECT doc_id, ord, 'a' || CASE WHEN l_quantity > 30 THEN repeat(chr(8195), CAST(least(12, greatest(1, round_even(l_quantity / 10, 0) - 2)) AS INTEGER)) ELSE '' END || ' b' AS text,
       CAST(10 AS DOUBLE) AS size, CAST(10 AS DOUBLE) AS lead_size FROM numbers""", ("numbers",))
def _(spark, folder):
    # spaces drawn over gaps of all widths, one or two of them
    n = corpus.numbers(spark, folder).select("doc_id", "ord", "l_quantity", F.posexplode(F.array(*map(F.lit, ["", "a", " ", " ", "b"]))).alias("gno", "c"))
    n = n.where((F.col("gno") != 3) | (F.col("ord") % 2 == 0)).where("gno > 0")
    x0 = F.when(F.col("gno") == 1, 0.0).when(F.col("gno") == 4, 5.0 + F.col("l_quantity")).otherwise(5.0 + F.col("gno") / 10)
    g = n.select("doc_id", "ord", "gno", "c", x0.alias("x0"), (x0 + F.when(F.col("c") == " ", 0.1).otherwise(5.0)).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"),
                 F.lit(10.0).alias("size"), F.lit(False).alias("icon"))
    return ops.build_lines(g, ["doc_id", "ord"]).select("doc_id", "ord", "text", "size", "lead_size")


BOUNDS = """
SELECT doc_id, page, col, min(x0) AS left, list_sort(list(x1))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS right
FROM text_lines WHERE length(replace(text, ' ', '')) >= 12 GROUP BY doc_id, page, col"""


@query("column_bounds", "C39", f"""
SELECT p.doc_id, p.page, c.col, coalesce(b.left, CASE c.col WHEN 0 THEN 36.0 ELSE 311.5 END) AS left, coalesce(b.right, CASE c.col WHEN 0 THEN 283.5 ELSE 559.0 END) AS right
FROM (SELECT DISTINCT doc_id, page FROM text_lines) p, (VALUES (0), (1)) c(col) LEFT JOIN ({BOUNDS}) b ON b.doc_id = p.doc_id AND b.page = p.page AND b.col = c.col""", ("text_lines",))
def _(spark, folder):
    lines = text_lines(spark, folder).withColumns({"glyphs": F.length(F.replace("text", F.lit(" "), F.lit(""))), "in_cell": F.lit(False), "crosses": F.lit(False)})
    pages = lines.select("doc_id", "page").distinct().withColumns({"split_x": F.lit(297.5), "width": F.lit(595.0)})
    return ops.page_bounds(pages, ops.col_bounds(lines)).select("doc_id", "page", "col", "left", "right")


@query("reading_order", "C40", """
WITH it AS (SELECT doc_id, page, sid, flag = 'A' AS box, CASE WHEN (x0 + x1) / 2 < 297.5 THEN 0 ELSE 1 END AS col, x0, y0, x1, y1, x0 < 287.5 AND x1 > 307.5 AS cr,
              CASE WHEN y1 <= 203 THEN 'up' WHEN y0 >= 597 THEN 'down' END AS side FROM shapes),
z AS (SELECT DISTINCT doc_id, page, side FROM it WHERE cr AND side IS NOT NULL
      UNION SELECT a.doc_id, a.page, a.side FROM it a JOIN it b ON a.doc_id = b.doc_id AND a.page = b.page AND a.side = b.side AND a.box AND b.box AND a.sid <> b.sid
            AND abs(a.x1 - 297.5) < 12 AND abs(a.x1 - b.x0) < 3 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.6 * least(a.y1 - a.y0, b.y1 - b.y0))
SELECT doc_id, page, sid, zone, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY zone, y0, x0, sid) AS INTEGER) AS pos FROM (
 SELECT it.*, CASE WHEN z.side = 'up' THEN 0 WHEN z.side = 'down' THEN 3 ELSE col + 1 END AS zone FROM it LEFT JOIN z ON z.doc_id = it.doc_id AND z.page = it.page AND z.side = it.side)""", ("shapes",))
def _(spark, folder):
    s = corpus.shapes(spark, folder)
    items = s.select("doc_id", "page", F.col("sid").alias("iid"), F.when((F.col("x0") + F.col("x1")) / 2 < 297.5, 0).otherwise(1).alias("col"), (F.col("flag") == "A").alias("box"), "x0", "y0", "x1", "y1")
    pages = s.select("doc_id", "page").distinct().withColumns({"split_x": F.lit(297.5), "div_y0": F.lit(200.0), "div_y1": F.lit(600.0), "single": F.lit(False)})
    return ops.reading_order(items, pages).select("doc_id", "page", F.col("iid").alias("sid"), "zone", "pos")


@query("brace_markers_attached", "C41", """
WITH f AS (SELECT doc_id, ord, CASE WHEN l_returnflag = 'A' AND l_quantity < 25 THEN '①' ELSE 'n' || number END AS text, CASE WHEN l_returnflag = 'A' AND l_quantity < 25 THEN 20.0::DOUBLE ELSE 60.0::DOUBLE + l_partkey % 2 * 1.5 END AS x0, ord * 11 AS y0 FROM numbers),
m AS (SELECT *, coalesce(text = '①' AND lag(text) OVER w <> '①' AND lead(text) OVER w <> '①' AND abs(lag(x0) OVER w - lead(x0) OVER w) < 2, false) AS mk FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, CASE WHEN nx THEN '① ' || text ELSE text END AS text FROM (SELECT *, coalesce(lead(mk) OVER (PARTITION BY doc_id ORDER BY ord), false) AS nx FROM m) WHERE NOT mk""", ("numbers",))
def _(spark, folder):
    mark = (F.col("l_returnflag") == "A") & (F.col("l_quantity") < 25)
    x0 = F.when(mark, 20.0).otherwise(F.lit(60.0) + F.col("l_partkey") % 2 * 1.5)
    flow = corpus.numbers(spark, folder).select(
        "doc_id", F.lit(1).alias("page"), F.lit(0).alias("col"), "ord", F.lit("line").alias("kind"), F.when(mark, "①").otherwise(F.concat(F.lit("n"), F.col("number").cast("string"))).alias("text"),
        x0.alias("x0"), (F.col("ord") * 11.0).alias("y0"), (x0 + 10).alias("x1"), F.lit(10.0).alias("size"))
    return ops.attach_markers(flow).select("doc_id", "ord", "text")


@query("boxes_continued", "C42", """
WITH f AS (SELECT doc_id, ord, number AS page, CASE WHEN l_returnflag = 'R' THEN 'line' ELSE 'box' END AS kind, CASE WHEN l_discount > 0.05 THEN l_linestatus END AS fill,
             l_partkey % 100 * 1.0::DOUBLE AS y0, 700.0::DOUBLE + l_quantity AS y1, l_quantity > 45 AS titled FROM numbers)
SELECT doc_id, ord, CAST(sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS chain FROM (
 SELECT *, coalesce(kind = 'box' AND lag(kind) OVER w = 'box' AND lag(page) OVER w <> page AND NOT coalesce(lag(fill) OVER w <> fill, false) AND lag(y1) OVER w >= 710 AND y0 <= 90 AND NOT titled, false) AS g
 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord))""", ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder)
    flow = n.select("doc_id", F.col("number").alias("page"), "ord", F.when(F.col("l_returnflag") == "R", "line").otherwise("box").alias("kind"), F.lit(0).alias("col"), F.lit(False).alias("single"),
                    F.when(F.col("l_discount") > 0.05, F.col("l_linestatus")).alias("fill"), (F.col("l_partkey") % 100 * 1.0).alias("y0"), (F.lit(700.0) + F.col("l_quantity")).alias("y1"),
                    F.lit(50.0).alias("top"), F.lit(750.0).alias("bottom"), (F.col("l_quantity") > 45).alias("titled"))
    body = n.select("doc_id").distinct().withColumn("body_size", F.lit(10.0))
    return ops.continue_boxes(flow, body).select("doc_id", "ord", "chain")


@query("document_metrics", "C43", """
SELECT p.doc_id, coalesce(body_size, 10.0) AS body_size, pages >= 2 AND framed >= 0.5 * pages AS faithful
FROM (SELECT doc_id, count(DISTINCT page) AS pages, count(DISTINCT page) FILTER (page % 3 <> 0) AS framed FROM glyphs GROUP BY doc_id) p
JOIN (SELECT doc_id, median(size) AS body_size FROM glyphs GROUP BY doc_id) b ON b.doc_id = p.doc_id""", ("glyphs",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder)
    pages = corpus.layout_rows(spark, folder).select("doc_id", "page").distinct().withColumn("framed", F.col("page") % 3 != 0)
    return ops.doc_metrics(g, pages)


@query("overlap_groups", "C45", """
SELECT grp, start, "end", CAST(sum(n) OVER (PARTITION BY grp ORDER BY start, "end") AS BIGINT) AS "group", count(*) AS copies FROM (
 SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY grp ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.2 * ("end" - start) THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT grp, start, "end" FROM intervals))
GROUP BY grp, start, "end", n""".replace("count(*) AS copies FROM (\n SELECT *,", "1 AS copies FROM (\n SELECT *,").replace('\nGROUP BY grp, start, "end", n', ""), ("intervals",))
def _(spark, folder):
    rects = corpus.intervals(spark, folder).select("grp", F.col("start").alias("x0"), F.col("end").alias("x1")).distinct()
    return ops.overlap_groups(rects, ["grp"]).select("grp", F.col("x0").alias("start"), F.col("x1").alias("end"), F.col("group").cast("long"), F.lit(1).alias("copies"))


@query("readings_picked", "C46", """
WITH RECURSIVE r AS (SELECT doc_id, ord AS reading, l_partkey % 100 * 1.0::DOUBLE AS x0, l_partkey % 100 + l_quantity AS x1, row_number() OVER (PARTITION BY doc_id ORDER BY -l_extendedprice, ord) AS k FROM numbers),
walk AS (
 SELECT doc_id, k, [{'a': x0, 'b': x1, 'r': reading}] AS taken FROM r WHERE k = 1
 UNION ALL
 SELECT r.doc_id, r.k, CASE WHEN len(list_filter(taken, lambda t: least(r.x1, t.b) - greatest(r.x0, t.a) > 0.3 * least(r.x1 - r.x0, t.b - t.a))) = 0
        THEN list_append(taken, {'a': r.x0, 'b': r.x1, 'r': r.reading}) ELSE taken END FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.k = w.k + 1)
SELECT doc_id, unnest(list_transform(taken, lambda t: t.r)) AS reading FROM walk w WHERE k = (SELECT max(k) FROM r WHERE r.doc_id = w.doc_id)""", ("numbers",))
def _(spark, folder):
    x0 = F.col("l_partkey") % 100 * 1.0
    tokens = corpus.numbers(spark, folder).select("doc_id", F.col("ord").alias("reading"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), F.col("l_extendedprice").alias("conf"))
    return ops.pick_readings(tokens, ["doc_id"])


@query("confident_regions", "C46", """SELECT doc_id, count(*) AS n, count(*) FILTER (l_quantity < 10) AS low FROM numbers GROUP BY doc_id HAVING count(*) FILTER (l_quantity < 10) <= 0.25 * count(*)""", ("numbers",))
def _(spark, folder):
    return ops.confident_regions(corpus.numbers(spark, folder).withColumn("conf", F.col("l_quantity")), ["doc_id"], 10.0)


@query("shape_consensus", "C47", """
WITH v AS (SELECT user_id AS shape, event_type AS c, count(*) AS n FROM (SELECT user_id, CASE WHEN event_id % 10 < 7 THEN 'click' ELSE event_type END AS event_type FROM events) GROUP BY ALL),
t AS (SELECT shape, sum(n) AS total, max(n) AS top, arg_min(c, (-n, c)) AS best FROM v GROUP BY shape)
SELECT event_id, CASE WHEN top >= 2 AND top >= 2 * n AND top >= 0.6 * total THEN best ELSE e.c END AS c
FROM (SELECT event_id, user_id, CASE WHEN event_id % 10 < 7 THEN 'click' ELSE event_type END AS c FROM events) e JOIN v ON v.shape = e.user_id AND v.c = e.c JOIN t ON t.shape = e.user_id""")
def _(spark, folder):
    tokens = table(spark, folder, "events").select("event_id", F.col("user_id").alias("shape"), F.when(F.col("event_id") % 10 < 7, "click").otherwise(F.col("event_type")).alias("c"))
    return ops.consensus(tokens).select("event_id", "c")


@query("vocabulary_fixed", "C48", r"""
WITH w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(text, '([\p{L}]{2,})', 1)) AS word FROM doc_lines),
vocab AS (SELECT doc_id, word, count(*) AS n FROM w WHERE line_no % 4 <> 3 GROUP BY ALL),
pre AS (SELECT DISTINCT doc_id, substr(word, 1, i) AS word FROM (SELECT doc_id, word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
unk AS (SELECT DISTINCT doc_id, word FROM w WHERE line_no % 4 = 3 AND (doc_id, word) NOT IN (SELECT (doc_id, word) FROM pre)),
mu AS (SELECT doc_id, word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS key FROM (SELECT doc_id, word, unnest(range(1, length(word) + 1)) AS i FROM unk)),
mv AS (SELECT doc_id, word AS fixed, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS key FROM (SELECT doc_id, word, unnest(range(1, length(word) + 1)) AS i FROM vocab WHERE n >= 3))
SELECT mu.doc_id, mu.word, min(fixed) AS fixed FROM mu JOIN mv ON mu.doc_id = mv.doc_id AND mu.key = mv.key AND mu.i = mv.i GROUP BY mu.doc_id, mu.word HAVING count(*) = 1""", ("doc_lines",))
def _(spark, folder):
    # every fourth line of a document stands for recognised text, the others are its body
    lines = corpus.doc_lines(spark, folder)
    vocab = ops.body_vocab(lines.where("line_no % 4 <> 3"), r"[\p{L}]{2,}")
    words = ops.body_vocab(lines.where("line_no % 4 = 3"), r"[\p{L}]{2,}")
    return ops.vocab_fix(words, vocab, F.lit(True))


@query("final_consonants_fixed", "C48", """
WITH b AS (SELECT l_suppkey % 5 AS doc_id, l_partkey % 19 AS k, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT doc_id, k, n FROM b WHERE (doc_id + k) % 3 <> 0 AND n >= 3""")
def _(spark, folder):
    # each part spells a two-syllable word ending in ㅂ; the same word read with ㅁ must be corrected back, but only in the
    # documents whose body has it, and a word read with another final consonant must stay
    rows = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 5).alias("doc_id"), (F.col("l_partkey") % 19).cast("int").alias("k"))
    spell = lambda final: F.concat(F.lit("스"), F.element_at(F.array(*[F.lit(chr(44032 + k * 588 + 28 * 4 + final)) for k in range(19)]), F.col("k") + 1))
    body = rows.select("doc_id", "k", spell(17).alias("word"))
    vocab = body.where("(doc_id + k) % 3 <> 0").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    read = rows.select("doc_id", spell(16).alias("word")).union(rows.select("doc_id", spell(4).alias("word")))
    fixes = ops.vocab_fix(read, vocab, ops.final_consonant_swap())
    return fixes.select("doc_id", F.col("fixed").alias("word")).join(body, ["doc_id", "word"]).groupBy("doc_id", "k").agg(F.count("*").alias("n")).select(
        "doc_id", F.col("k").cast("long").alias("k"), "n")


@query("line_end_spaces", "C49", r"""
WITH vocab AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([\p{L}]+)', 1)) AS word FROM documents),
pre AS (SELECT DISTINCT doc_id, substr(word, 1, i) AS word FROM (SELECT doc_id, word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
p AS (SELECT doc_id, ord, regexp_extract(rtrim(text), '[\p{L}]+$') AS w1, regexp_extract(ltrim(nx), '^[\p{L}]+') AS w2 FROM (
      SELECT doc_id, ord, text, lead(text) OVER (PARTITION BY doc_id, page, col ORDER BY ord) AS nx FROM text_lines))
SELECT doc_id, ord, (doc_id, w1 || w2) NOT IN (SELECT (doc_id, word) FROM pre) AND (doc_id, w1) IN (SELECT (doc_id, word) FROM vocab) AND (doc_id, w2) IN (SELECT (doc_id, word) FROM pre) AS space
FROM p WHERE w1 <> '' AND w2 <> ''""", ("text_lines",))
def _(spark, folder):
    lines = text_lines(spark, folder)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1)))
    vocab = table(spark, folder, "documents").select("doc_id", F.explode(words).alias("word"))
    from pyspark.sql.window import Window
    area = Window.partitionBy("doc_id", "page", "col").orderBy("ord")
    pairs = lines.select("doc_id", "ord", F.regexp_extract(F.rtrim("text"), r"([\p{L}]+)$", 1).alias("w1"), F.regexp_extract(F.ltrim(F.lead("text").over(area)), r"^([\p{L}]+)", 1).alias("w2"))
    return ops.line_end_space(pairs.where("w1 <> '' and w2 <> ''"), vocab).select("doc_id", "ord", "space")


@query("lines_below", "C49", """
SELECT a.doc_id, a.page, a.col, a.ord, arg_min(b.ord, (b.y0, b.ord)) AS below FROM text_lines a JOIN text_lines b ON a.doc_id = b.doc_id AND a.page = b.page AND a.col = b.col
 AND b.y0 - a.y0 > 0.6 * (a.y1 - a.y0) AND b.y0 - a.y0 < 2.8 * (a.y1 - a.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0) GROUP BY ALL""", ("text_lines",))
def _(spark, folder):
    return ops.line_below(text_lines(spark, folder))


@query("pill_words_voted", "C30", r"""
SELECT source AS doc_id, arg_min(word, (-n, first_doc)) AS word, max(n) AS n FROM (
 SELECT source, word, count(*) AS n, min((doc_id, k)) AS first_doc FROM (SELECT source, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM (SELECT source, doc_id, regexp_extract_all(text, '([a-z]{1,4})\.', 1) AS ws FROM documents)) GROUP BY ALL) GROUP BY source""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), "text")
    return ops.pill_word(docs, r"([a-z]{1,4})\.")


@query("extraction_stats", "C50", """
SELECT doc_id, count(*) AS rows, count(*) FILTER (y0 < 90) AS band, count(DISTINCT page) AS pages FROM layout_rows GROUP BY doc_id""", ("layout_rows",))
def _(spark, folder):
    rows = corpus.layout_rows(spark, folder)
    each = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("y0") < 90).alias("band"))
    each = each.join(rows.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id")
    counters = each.select("doc_id", F.explode(F.create_map(*[x for c in ("rows", "band", "pages") for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    return ops.extract_stats(counters).select("doc_id", *[F.col("stats")[c].alias(c) for c in ("rows", "band", "pages")])


@query("boxed_letters", "C3", """
WITH g AS (SELECT doc_id, page, sid AS gid, flag = 'A' AND status = 'O' AS sq, flag = 'R' AND status = 'F' AS blank, x0 / 4 AS x0, y0 / 4 AS y0, CASE WHEN flag = 'A' AND status = 'O' THEN x0 / 4 + 60 ELSE x0 / 4 + 5 END AS x1,
                  CASE WHEN flag = 'A' AND status = 'O' THEN y0 / 4 + 60 ELSE y0 / 4 + 5 END AS y1 FROM shapes),
n AS (SELECT b.doc_id, b.page, b.gid AS bg, min(g.gid) AS gid, count(*) AS n FROM g b JOIN g ON g.doc_id = b.doc_id AND g.page = b.page AND g.gid <> b.gid AND b.sq AND NOT g.blank
   AND g.x0 >= b.x0 - 0.5 AND g.x1 <= b.x1 + 0.5 AND g.y0 >= b.y0 - 0.5 AND g.y1 <= b.y1 + 0.5 GROUP BY ALL HAVING count(*) = 1)
SELECT g.doc_id, g.page, g.gid, n2.gid IS NOT NULL AS boxed FROM g LEFT JOIN (SELECT DISTINCT doc_id, page, gid FROM n) n2 ON n2.doc_id = g.doc_id AND n2.page = g.page AND n2.gid = g.gid
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = g.doc_id AND n.page = g.page AND n.bg = g.gid)
AND NOT (g.blank AND EXISTS (SELECT 1 FROM n JOIN g b ON b.doc_id = n.doc_id AND b.page = n.page AND b.gid = n.bg WHERE n.doc_id = g.doc_id AND n.page = g.page AND g.x0 >= b.x0 AND g.x0 < b.x1 AND (g.y0 + g.y1) / 2 BETWEEN b.y0 AND b.y1))""", ("shapes",))
def _(spark, folder):
    square = (F.col("flag") == "A") & (F.col("status") == "O")
    blank = (F.col("flag") == "R") & (F.col("status") == "F")
    side = F.when(square, 60.0).otherwise(5.0)
    g = corpus.shapes(spark, folder).select(
        "doc_id", "page", F.col("sid").alias("gid"), F.when(square, "□").when(blank, " ").otherwise("가").alias("c"), (F.col("x0") / 4).alias("x0"), (F.col("y0") / 4).alias("y0"),
        (F.col("x0") / 4 + side).alias("x1"), (F.col("y0") / 4 + side).alias("y1"), F.lit(10.0).alias("size"))
    return ops.merge_boxed(g).select("doc_id", "page", "gid", "boxed")
