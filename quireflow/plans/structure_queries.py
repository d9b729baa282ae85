"""Passages, questions, choices and answers over whole tables."""

from pyspark.sql import functions as F

from quireflow.conventions import CIRCLED
from quireflow.functions import scan
from quireflow.functions import text as tx
from quireflow.operators import structure as ops
from quireflow.plans.registry import query, sql_view
from quireflow.sources import corpus
from quireflow.sources.corpus import table

DIGITS_SQL = "['①','②','③','④','⑤','⑥','⑦','⑧','⑨','⑩']"


def digit(column):
    return F.element_at(F.array(*[F.lit(c) for c in CIRCLED]), column)


def chunked(df):
    return df.withColumn("chunk", F.col("number"))


@query("answer_heads_joined", "D1", """
SELECT doc_id, ord, text, CAST(y0 AS DOUBLE) AS y0 FROM (
 SELECT doc_id, ord * 2 AS ord, text, ord * 40.0 AS y0 FROM turns WHERE kind <> 'answer'
 UNION ALL SELECT doc_id, ord * 2 + 1, number || ') ' || regexp_replace(text, '^\\d+\\) ', ''), ord * 40.0 FROM turns WHERE kind = 'answer' AND number % 3 <> 0
 UNION ALL SELECT doc_id, ord * 2, number || ')', ord * 40.0 FROM turns WHERE kind = 'answer' AND number % 3 = 0
 UNION ALL SELECT doc_id, ord * 2 + 1, regexp_replace(text, '^\\d+\\) ', ''), ord * 40.0 + 20 FROM turns WHERE kind = 'answer' AND number % 3 = 0)""".replace("\\\\", "\\"), ("turns",))
def _(spark, folder):
    # answers are printed on two lines; every third answer tag stands too far to the right
    t = corpus.turns(spark, folder)
    bare = F.regexp_replace("text", r"^\d+\) ", "")
    both = F.array(F.struct(F.lit(0).alias("k"), F.concat(F.col("number").cast("string"), F.lit(")")).alias("text")),
                   F.struct(F.lit(1).alias("k"), bare.alias("text")))
    one = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("text")))
    lines = t.select("doc_id", "chunk", "ord", "number", F.explode(F.when(F.col("kind") == "answer", both).otherwise(one)).alias("l"))
    far = (F.col("l.k") == 1) & (F.col("number") % 3 == 0)
    lines = lines.select("doc_id", "chunk", (F.col("ord") * 2 + F.col("l.k")).alias("ord"), F.lit(1).alias("page"), F.lit(0).alias("col"),
                         F.col("l.text").alias("text"), F.when(far, 80.0).otherwise(36.0).alias("x0"),
                         (F.col("ord") * 40.0 + F.col("l.k") * 20).alias("y0"), F.lit(10.0).alias("size"))
    return ops.join_heads(lines).select("doc_id", "ord", "text", "y0")


@query("question_numbers", "D2", """
SELECT doc_id, ord, coalesce(CASE WHEN ord % 5 = 4 THEN NULL WHEN kind = 'question' THEN CASE WHEN number % 2 = 0 OR number % 3 = 0 THEN number END
       WHEN kind = 'guide' THEN 7 END, 0) AS number FROM turns""", ("turns",))
def _(spark, folder):
    t = corpus.turns(spark, folder)
    text = F.when(F.col("kind") == "guide", F.concat(F.lit("7  "), "text")).otherwise(F.col("text"))
    big = (F.col("number") % 2 == 0) | (F.col("kind") == "guide")
    lines = t.select("doc_id", "ord", text.alias("text"), F.when(F.col("ord") % 5 == 4, 1).alias("box"), F.lit(10.0).alias("body"),
                     F.when(big, 12.0).otherwise(10.0).alias("lead_size"), (F.col("number") % 3 == 0).alias("bold"),
                     F.lit(12.0).alias("digits_size"), F.lit(10.0).alias("next_size"))
    return ops.question_numbers(lines).select("doc_id", "ord", F.coalesce("number", F.lit(0)).alias("number"))


@query("answer_section_start", "D3", """
SELECT doc_id, min(number) AS first_answer, arg_min(ord, number) AS answer_ord FROM turns WHERE kind = 'answer' GROUP BY doc_id""", ("turns",))
def _(spark, folder):
    return ops.answer_start(corpus.turns(spark, folder))


SCAN = """
WITH RECURSIVE cand AS (SELECT doc_id, ord, number, l_discount >= 0.05 AS big FROM numbers),
starts AS (SELECT doc_id, start, min(rank) AS rank FROM (
   SELECT DISTINCT doc_id, 1 AS rank, 1 AS start FROM cand UNION ALL SELECT doc_id, 2, arg_min(number, ord) FROM cand GROUP BY doc_id) GROUP BY doc_id, start),
walk AS (
  SELECT doc_id, start, 0 AS ord, start AS expected, 0 AS hit, 0 AS number, 0 AS skipped FROM starts
  UNION ALL
  SELECT w.doc_id, w.start, c.ord,
         CASE WHEN c.number = w.expected THEN w.expected + 1 WHEN c.big AND c.number IN (w.expected + 1, w.expected + 2) THEN c.number + 1 ELSE w.expected END,
         CASE WHEN c.number = w.expected OR (c.big AND c.number IN (w.expected + 1, w.expected + 2)) THEN 1 ELSE 0 END, c.number, c.number - w.expected
  FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.ord = w.ord + 1)"""


@query("question_heads_scanned", "D4", SCAN + """
SELECT w.doc_id, w.ord, w.number, w.skipped FROM walk w JOIN (
 SELECT doc_id, arg_max(start, (n, -rank)) AS start, max(n) AS n FROM (SELECT s.doc_id, s.start, s.rank, sum(hit) AS n FROM walk w JOIN starts s ON w.doc_id = s.doc_id AND w.start = s.start GROUP BY ALL)
 GROUP BY doc_id) b ON b.doc_id = w.doc_id AND b.start = w.start
JOIN (SELECT doc_id, count(*) AS heads, min(l_partkey) % 2 = 0 AS faithful FROM numbers GROUP BY doc_id) f ON f.doc_id = w.doc_id
WHERE hit = 1 AND (NOT faithful OR b.n >= 0.5 * heads)""", ("numbers",))
def _(spark, folder):
    n = chunked(corpus.numbers(spark, folder))
    faithful = n.groupBy("doc_id").agg((F.min("l_partkey") % 2 == 0).alias("faithful"))
    cand = n.select("doc_id", "ord", "chunk", "number", (F.col("l_discount") >= 0.05).alias("big"))
    return ops.scan_headers(cand, faithful=faithful)


@query("icon_labels_voted", "D5", f"""
WITH votes AS (SELECT conv_id // 10 AS scope, conv_id AS question, turn, role || length(text) % 2 AS digest,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT scope, digest, {DIGITS_SQL}[arg_min(k, (-n, q, t))] AS label, max(n) AS votes
FROM (SELECT scope, digest, k, count(*) AS n, min(question) AS q, arg_min(turn, question) AS t FROM votes WHERE k <= 10 GROUP BY scope, digest, k)
GROUP BY scope, digest""")
def _(spark, folder):
    leads = table(spark, folder, "conversations").select(
        F.floor(F.col("conv_id") / 10).alias("scope"), F.col("conv_id").alias("question"), F.col("turn").alias("ord"),
        F.concat("role", (F.length("text") % 2).cast("string")).alias("digest"))
    return ops.label_icons(leads, ["scope"])


@query("icon_labels_unheaded", "D5", f"""
WITH RECURSIVE l AS (SELECT conv_id // 10 AS doc_id, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) AS k, conv_id, length(text) % 7 AS digest FROM conversations),
walk AS (
 SELECT doc_id, k, conv_id, digest, 1 AS run, 1 AS place, [digest] AS seen FROM l WHERE k = 1
 UNION ALL
 SELECT n.doc_id, n.k, n.conv_id, n.digest, w.run + fresh::INT, CASE WHEN fresh THEN 1 ELSE w.place + 1 END, CASE WHEN fresh THEN [n.digest] ELSE list_append(w.seen, n.digest) END
 FROM walk w JOIN l n ON n.doc_id = w.doc_id AND n.k = w.k + 1, LATERAL (SELECT n.conv_id <> w.conv_id OR list_contains(w.seen, n.digest) AS fresh)),
votes AS (SELECT w.* FROM walk w JOIN (SELECT doc_id, run FROM walk GROUP BY ALL HAVING count(*) >= 3) g ON g.doc_id = w.doc_id AND g.run = w.run WHERE place <= 10)
SELECT doc_id, digest, {DIGITS_SQL}[arg_min(place, (-n, seen))] AS label, max(n) AS votes FROM (SELECT doc_id, digest, place, count(*) AS n, min(k) AS seen FROM votes GROUP BY ALL) GROUP BY doc_id, digest""")
def _(spark, folder):
    conv = table(spark, folder, "conversations").select(F.floor(F.col("conv_id") / 10).alias("doc_id"), F.col("conv_id").alias("page"), "turn", (F.length("text") % 7).cast("long").alias("digest"))
    leads = scan.numbered(conv, ["doc_id"], ["page"], ["turn"], "ord").select("doc_id", "ord", F.col("page").alias("chunk"), "page", F.lit(0).alias("col"), F.lit(50.0).alias("x0"), "digest")
    return ops.label_icons_unheaded(leads)


@query("nearest_icon_label", "D6", """
SELECT vec_id, CASE WHEN mse < 0.03 THEN label ELSE -1 END AS nearest, round_even(mse * 1000000, 0) / 1000000 AS mse FROM (
 SELECT e.vec_id, min(d) AS mse, arg_min(label, (d, label)) AS label FROM (
  SELECT e.vec_id, p.label, list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / 64 AS d
  FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) p) e GROUP BY e.vec_id)""")
def _(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.lit(0).alias("scope"), F.col("label").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    prototypes = vectors.groupBy("scope", "label").agg(F.min_by("vector", "vec_id").alias("vector"))
    out = ops.nearest_label(vectors.drop("label"), prototypes, ["scope"], 0.03)
    return out.select("vec_id", F.coalesce("nearest", F.lit(-1)).alias("nearest"), tx.half_even(F.col("mse"), 6).alias("mse"))


@query("blocks_segmented", "D7", """
SELECT doc_id, ord, CAST(sum(CASE WHEN kind IN ('guide', 'question') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block,
       CAST(sum(CASE WHEN kind = 'guide' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS passage_id,
       coalesce(last_value(CASE WHEN kind IN ('guide', 'question') THEN kind END IGNORE NULLS) OVER w, 'loose') AS block_kind
FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""", ("turns",))
def _(spark, folder):
    return ops.segment(corpus.turns(spark, folder)).select("doc_id", "ord", "block", "passage_id", "block_kind")


@query("loose_notes", "D8", """
SELECT doc_id, row_no AS ord, coalesce(lag(page) OVER (PARTITION BY doc_id ORDER BY row_no) <> page, true) AS top,
       'p' || page || ': ' || substr(text, 1, 30) AS note FROM layout_rows""", ("layout_rows",))
def _(spark, folder):
    items = corpus.layout_rows(spark, folder).select("doc_id", "page", F.col("row_no").alias("ord"), "text")
    return ops.loose_notes(items).select("doc_id", "ord", "top", "note")


def text_lines(spark, folder):
    """Rows as lines with bounds; a row that ends in a blank kept its line-end space."""
    rows = corpus.layout_rows(spark, folder)
    left = F.lit(36.0) + F.col("col") * 270
    return rows.select("doc_id", "page", "col", F.col("row_no").alias("ord"), "line_no", "wrap", "text", "x0", "x1", "y0", "y1", "size",
                       left.alias("left"), (left + 240).alias("right"), F.col("text").endswith(" ").alias("trailing_space"))


sql_view("text_lines", """
SELECT doc_id, page, col, row_no AS ord, line_no, wrap, text, x0, x1, y0, y1, size, 36.0::DOUBLE + 270 * col AS left_x,
       276.0::DOUBLE + 270 * col AS right_x, text LIKE '% ' AS trailing_space FROM layout_rows""", ("layout_rows",))
RELIABLE = """
SELECT doc_id, count(*) FILTER (x1 >= right_x - greatest(1.2 * size, 6)) AS "full",
       count(*) FILTER (x1 >= right_x - greatest(1.2 * size, 6)) > 0
       AND count(*) FILTER (x1 >= right_x - greatest(1.2 * size, 6) AND trailing_space) >= 0.05 * count(*) FILTER (x1 >= right_x - greatest(1.2 * size, 6)) AS reliable
FROM text_lines GROUP BY doc_id"""


@query("line_end_spaces_reliable", "D9", RELIABLE, ("text_lines",))
def _(spark, folder):
    return ops.space_reliable(text_lines(spark, folder))


@query("paragraphs", "D10", """
WITH RECURSIVE l AS (
 SELECT doc_id, page, col, size, y0, text, rx, row_number() OVER w AS k, ord, x1 >= right_x - greatest(1.2 * size, 6) AS is_full,
        regexp_matches(text, '^\\s*\\d{1,2}\\s?\\.\\s') AS numbered,
        regexp_matches(text, '^\\s*([①-⑳]|\\([A-Za-z0-9]\\)(\\s|$)|[A-Z]\\s*\\.|\\d{1,2}\\s*\\.(\\D|$)|[-–—•·]\\s|[가-힣A-Za-z]{1,6}\\s?:|S#|\\[[^\\]]{1,20}\\])') AS marker,
        lag(page) OVER w AS p_page, lag(col) OVER w AS p_col, lag(y0) OVER w AS p_y0, lag(size) OVER w AS p_size,
        lag(x1 >= right_x - greatest(1.2 * size, 6)) OVER w AS p_full
 FROM (SELECT doc_id, page, col, ord, size, y0, x1, right_x, CASE WHEN wrap = 0 AND line_no % 7 = 3 THEN '3. ' || text ELSE text END AS text,
              x0 - left_x + CASE WHEN wrap = 0 THEN 10 ELSE 0 END AS rx FROM text_lines)
 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
p AS (SELECT doc_id, coalesce(median(y0 - p_y0) FILTER (page = p_page AND col = p_col AND y0 > p_y0 AND y0 - p_y0 < 3.5 * p_size), 1.5 * median(size)) AS pitch FROM l GROUP BY doc_id),
e AS (SELECT l.*, pitch, coalesce(page = p_page AND col = p_col, false) AS same, y0 - p_y0 AS dy FROM l JOIN p USING (doc_id)),
walk AS (
 SELECT doc_id, k, ord, rx AS first_rx, numbered AS first_no, rx AS second_rx, 1 AS n, 1 AS para FROM e WHERE k = 1
 UNION ALL
 SELECT doc_id, k, ord, CASE WHEN brk THEN rx ELSE first_rx END, CASE WHEN brk THEN numbered ELSE first_no END,
        CASE WHEN brk OR n = 1 THEN rx ELSE second_rx END, CASE WHEN brk THEN 1 ELSE n + 1 END, para + CASE WHEN brk THEN 1 ELSE 0 END
 FROM (SELECT *, NOT p_full OR (same AND dy > 1.3 * pitch AND NOT hang) OR (marker AND rx <= first_rx + 0.4 * size)
              OR (abs(size - p_size) > 0.15 * greatest(size, p_size) AND NOT hang)
              OR (n >= 2 AND rx > second_rx + CASE WHEN same THEN 0.4 ELSE 1.0 END * size) AS brk
       FROM (SELECT e.*, w.first_rx, w.first_no, w.second_rx, w.n, w.para,
                    same AND w.first_no AND e.p_full AND e.rx - w.first_rx BETWEEN 0.8 * e.size AND 3 * e.size AND dy > 0 AND dy <= 3 * e.size
                    AND (w.n = 1 OR abs(e.rx - w.second_rx) < 0.4 * e.size) AS hang
             FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.k = w.k + 1)))
SELECT doc_id, ord, CAST(para AS BIGINT) AS para FROM walk""".replace("\\\\", "\\"), ("text_lines",))
def _(spark, folder):
    lines = text_lines(spark, folder)
    first = F.col("wrap") == 0
    lines = lines.withColumns({
        "text": F.when(first & (F.col("line_no") % 7 == 3), F.concat(F.lit("3. "), "text")).otherwise(F.col("text")),
        "rx": F.col("x0") - F.col("left") + F.when(first, 10).otherwise(0),
        "frame": F.lit(None).cast("string"), "gap_below": F.lit(None).cast("double")})
    return ops.paragraphs(lines)


@query("stanza_breaks", "D10", """
WITH RECURSIVE l AS (
 SELECT doc_id, page, col, size, y0, rx, gap, row_number() OVER w AS k, ord, x1 >= right_x - greatest(1.2 * size, 6) AS is_full,
        regexp_matches(text, '^\\s*\\d{1,2}\\s?\\.\\s') AS numbered,
        regexp_matches(text, '^\\s*([①-⑳]|\\([A-Za-z0-9]\\)(\\s|$)|[A-Z]\\s*\\.|\\d{1,2}\\s*\\.(\\D|$)|[-–—•·]\\s|[가-힣A-Za-z]{1,6}\\s?:|S#|\\[[^\\]]{1,20}\\])') AS marker,
        lag(page) OVER w AS p_page, lag(col) OVER w AS p_col, lag(y0) OVER w AS p_y0, lag(size) OVER w AS p_size, lag(gap) OVER w AS p_gap,
        lag(x1 >= right_x - greatest(1.2 * size, 6)) OVER w AS p_full
 FROM (SELECT doc_id, page, col, ord, size, y0, x1, right_x, CASE ord % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 3.0 END AS gap, CASE WHEN wrap = 0 AND line_no % 7 = 3 THEN '3. ' || text ELSE text END AS text,
              x0 - left_x + CASE WHEN wrap = 0 THEN 10 ELSE 0 END AS rx FROM (SELECT * REPLACE (y0 + floor(ord / 3) * 12 AS y0) FROM text_lines))
 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
p AS (SELECT doc_id, coalesce(median(y0 - p_y0) FILTER (page = p_page AND col = p_col AND y0 > p_y0 AND y0 - p_y0 < 3.5 * p_size), 1.5 * median(size)) AS pitch FROM l GROUP BY doc_id),
e AS (SELECT l.*, pitch, coalesce(page = p_page AND col = p_col, false) AS same, y0 - p_y0 AS dy FROM l JOIN p USING (doc_id)),
walk AS (
 SELECT doc_id, k, ord, rx AS first_rx, numbered AS first_no, rx AS second_rx, 1 AS n, false AS blank FROM e WHERE k = 1
 UNION ALL
 SELECT doc_id, k, ord, CASE WHEN brk THEN rx ELSE first_rx END, CASE WHEN brk THEN numbered ELSE first_no END,
        CASE WHEN brk OR n = 1 THEN rx ELSE second_rx END, CASE WHEN brk THEN 1 ELSE n + 1 END, brk AND CASE WHEN same THEN dy > 1.7 * pitch AND NOT hang ELSE roomy END
 FROM (SELECT *, NOT p_full OR roomy OR (same AND dy > 1.3 * pitch AND NOT hang) OR (marker AND rx <= first_rx + 0.4 * size)
              OR (abs(size - p_size) > 0.15 * greatest(size, p_size) AND NOT hang)
              OR (n >= 2 AND rx > second_rx + CASE WHEN same THEN 0.4 ELSE 1.0 END * size) AS brk
       FROM (SELECT e.*, w.first_rx, w.first_no, w.second_rx, w.n, NOT e.same AND coalesce(e.p_gap > 1.25 * e.pitch, false) AS roomy,
                    same AND w.first_no AND e.p_full AND e.rx - w.first_rx BETWEEN 0.8 * e.size AND 3 * e.size AND dy > 0 AND dy <= 3 * e.size
                    AND (w.n = 1 OR abs(e.rx - w.second_rx) < 0.4 * e.size) AS hang
             FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.k = w.k + 1)))
SELECT doc_id, ord FROM walk WHERE blank""".replace("\\\\", "\\"), ("text_lines",))
def _(spark, folder):
    # every third line stands 12 points further down
    lines = text_lines(spark, folder)
    first = F.col("wrap") == 0
    lines = lines.withColumns({
        "text": F.when(first & (F.col("line_no") % 7 == 3), F.concat(F.lit("3. "), "text")).otherwise(F.col("text")),
        "rx": F.col("x0") - F.col("left") + F.when(first, 10).otherwise(0), "y0": F.col("y0") + F.floor(F.col("ord") / 3) * 12,
        "frame": F.lit(None).cast("string"), "gap_below": F.when(F.col("ord") % 4 == 0, 30.0).when(F.col("ord") % 4 == 1, 3.0)})
    tested = ops.line_tests(lines)
    return ops.stanza_breaks(lines, ops.paragraphs(lines, tested=tested), tested=tested)


@query("bracket_groups", "D11", """
WITH rest AS (SELECT doc_id, ord, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS b FROM numbers WHERE NOT (number = 1 AND l_returnflag <> 'R')),
lab AS (SELECT doc_id, l_returnflag AS b, arg_max('[' || l_linestatus || ']', ord) AS label FROM numbers WHERE number = 1 AND l_returnflag <> 'R' GROUP BY 1, 2)
SELECT r.doc_id, r.b AS bracket, label, min(ord) AS first, max(ord) AS last, count(*) AS lines
FROM (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM (
      SELECT *, CASE WHEN b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY ord) THEN 1 ELSE 0 END AS cut FROM rest)) r
JOIN lab ON lab.doc_id = r.doc_id AND lab.b = r.b GROUP BY r.doc_id, r.b, run, label""", ("numbers",))
def _(spark, folder):
    n = chunked(corpus.numbers(spark, folder))
    flagged = F.col("l_returnflag") != "R"
    lines = n.select("doc_id", "chunk", "ord", F.when(flagged, F.col("l_returnflag")).alias("bracket"),
                     ((F.col("number") == 1) & flagged).alias("bracket_label"), F.concat(F.lit(" ["), "l_linestatus", F.lit("] ")).alias("text"))
    return ops.bracket_groups(lines).drop("run")


@query("paragraph_text", "D12", f"""
SELECT t.doc_id, line_no, string_agg(piece, '' ORDER BY ord) AS text FROM (
 SELECT t.doc_id, line_no, ord, CASE WHEN wrap = min(wrap) OVER (PARTITION BY t.doc_id, line_no) THEN text
        WHEN NOT reliable OR lag(trailing_space) OVER (PARTITION BY t.doc_id, line_no ORDER BY ord) THEN ' ' || text ELSE text END AS piece
 FROM text_lines t JOIN ({RELIABLE}) r ON r.doc_id = t.doc_id) t GROUP BY t.doc_id, line_no""", ("text_lines",))
def _(spark, folder):
    lines = text_lines(spark, folder).withColumn("emphasis_ends", F.lit(False))
    return ops.para_text(lines, ops.space_reliable(lines), ["doc_id", "line_no"])


@query("look_runs", "D13", """
SELECT doc_id, page, row_no, CAST(count(*) AS BIGINT) AS runs, string_agg(length(t) || CASE WHEN underline THEN '_' ELSE '' END, ',' ORDER BY run) AS shape FROM (
 SELECT doc_id, page, row_no, run, string_agg(c, '') AS t, any_value(underline) AS underline FROM (
  SELECT *, sum(CASE WHEN look = lag(look) OVER w AND underline = lag(underline) OVER w THEN 0 ELSE 1 END) OVER w AS run FROM (
   SELECT doc_id, page, row_no, gno, c, (gno // 7) % 2 = 0 AS underline,
          coalesce(last_value(CASE WHEN c <> ' ' THEN (ascii(c) % 5 = 0)::INT * 10 + ascii(c) % 2 END IGNORE NULLS) OVER (PARTITION BY doc_id, page, row_no ORDER BY gno),
                   (ascii(c) % 5 = 0)::INT * 10 + ascii(c) % 2) AS look
   FROM (SELECT doc_id, page, row_no, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS gno FROM layout_rows))
  WINDOW w AS (PARTITION BY doc_id, page, row_no ORDER BY gno)) GROUP BY doc_id, page, row_no, run)
GROUP BY doc_id, page, row_no""".replace("sum(CASE WHEN look = lag(look) OVER w AND underline = lag(underline) OVER w THEN 0 ELSE 1 END) OVER w AS run FROM (",
                                         "sum(cut) OVER w AS run FROM (SELECT *, CASE WHEN look = lag(look) OVER w AND underline = lag(underline) OVER w THEN 0 ELSE 1 END AS cut FROM (")
       .replace("FROM layout_rows))\n  WINDOW", "FROM layout_rows)) WINDOW w AS (PARTITION BY doc_id, page, row_no ORDER BY gno))\n  WINDOW"), ("layout_rows",))
def _(spark, folder):
    rows = corpus.layout_rows(spark, folder).select("doc_id", "page", "row_no", F.posexplode(F.split("text", "")).alias("gno", "c"))
    code = F.ascii("c")
    g = rows.withColumns({"underline": F.floor(F.col("gno") / 7) % 2 == 0, "bold": code % 5 == 0,
                          "color": F.when(code % 2 == 1, "#FF0000"), "size": F.lit(10.1)})
    out = ops.runs(g, ["doc_id", "page", "row_no"])
    shown = F.concat(F.length("text").cast("string"), F.when(F.col("underline"), "_").otherwise(""))
    return out.groupBy("doc_id", "page", "row_no").agg(F.count("*").alias("runs"), ops.ordered_concat(["run"], shown, ",").alias("shape"))


def number_lines(spark, folder):
    """Line items as lines of a paragraph (the order), placed by part and quantity."""
    n = corpus.numbers(spark, folder)
    x0 = F.lit(36.0) + F.col("l_partkey") % 260
    return n.select("doc_id", "ord", "number", F.when(F.col("l_returnflag") == "A", "- x").otherwise("x").alias("text"), x0.alias("x0"),
                    F.least(F.lit(306.0), x0 + F.col("l_quantity") * 5).alias("x1"), (F.col("ord") * 14.0 + F.col("l_partkey") % 3).alias("y0"),
                    F.lit(10.0).alias("size"), F.lit(36.0).alias("left"), F.lit(306.0).alias("right"), "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")


sql_view("number_lines", """
SELECT *, least(306.0::DOUBLE, x0 + l_quantity * 5) AS x1 FROM (
 SELECT doc_id, ord, number, CASE WHEN l_returnflag = 'A' THEN '- x' ELSE 'x' END AS text, 36.0::DOUBLE + l_partkey % 260 AS x0,
        ord * 14.0::DOUBLE + l_partkey % 3 AS y0, l_partkey, l_quantity, l_returnflag, l_linestatus, l_discount FROM numbers)""", ("numbers",))


@query("paragraph_layout", "D14", """
SELECT doc_id, CASE WHEN r THEN 'RIGHT' WHEN c THEN 'CENTER' ELSE 'LEFT' END AS align, CASE WHEN r AND ftext LIKE '-%' THEN 'credit' ELSE '' END AS role,
       CASE WHEN r OR c THEN 0.0::DOUBLE WHEN n >= 2 THEN x1st - x2nd WHEN x1st - 36 > 4 THEN x1st - 36 ELSE 0.0 END AS indent,
       CAST(coalesce(round_even(pitch / 10 * 100, 0), 0) AS INTEGER) AS line_pct
FROM (SELECT *, n <= 2 AND at_right AND x1st > 36 + 81.0 AS r,
             n = 1 AND abs((x1st - 36) - (306 - fx1)) < 0.04 * 270 AND x1st > 36 + 0.15 * 270 AS c
      FROM (SELECT doc_id, count(*) AS n, bool_and(x1 >= 306 - 12) AS at_right, max(x0) FILTER (ord = 1) AS x1st, max(x1) FILTER (ord = 1) AS fx1,
                   max(x0) FILTER (ord = 2) AS x2nd, max(text) FILTER (ord = 1) AS ftext, median(dy) FILTER (dy > 0) AS pitch
            FROM (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY ord) AS dy FROM number_lines) GROUP BY doc_id))""", ("number_lines",))
def _(spark, folder):
    return ops.para_layout(number_lines(spark, folder), ["doc_id"])


@query("paragraph_metrics", "D14", """
WITH l AS (SELECT doc_id, line_no, ord, page, col, wrap, size, y0 - CASE WHEN beside THEN 13 ELSE 0 END AS y0, CASE WHEN beside THEN 300.0 + 270 * col ELSE x0 + shift END AS x0, CASE WHEN beside THEN 310.0 + 270 * col ELSE x1 + shift END AS x1,
             left_x, right_x, CASE WHEN line_no % 13 = 5 THEN '[A]' WHEN line_no % 13 = 6 THEN '- ' || text ELSE text END AS text, CASE WHEN wrap = 0 AND line_no % 5 = 0 THEN 16.0 WHEN wrap = 0 AND line_no % 5 = 1 THEN 12.0 ELSE size END AS big
      FROM (SELECT *, wrap > 0 AND ord % 11 = 0 AS beside, CASE WHEN wrap = 0 AND line_no % 3 = 0 THEN 10 WHEN length(text) < 30 AND line_no % 3 = 1 THEN (right_x - x1) / CASE WHEN line_no % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS shift FROM text_lines)),
p AS (SELECT *, coalesce(lag(page) OVER w = page AND lag(col) OVER w = col AND abs(y0 - lag(y0) OVER w) < 0.4 * lag(size) OVER w AND x0 > lag(x1) OVER w, false) AS piece, x0 - left_x AS rx FROM l WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY ord)),
b AS (SELECT doc_id, arg_min(base, (-n, seen)) AS base FROM (SELECT doc_id, round_even(rx, 0) AS base, count(*) AS n, min(ord) AS seen FROM p GROUP BY 1, 2) GROUP BY doc_id),
h AS (SELECT *, row_number() OVER w AS no, lag(page) OVER w = page AND lag(col) OVER w = col AS same, y0 - lag(y0) OVER w AS dy, first_value(right_x) OVER w AS r1, first_value(size) OVER w AS s1 FROM p WHERE NOT piece WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY ord)),
g AS (SELECT doc_id, line_no, count(*) AS n, bool_and(x1 >= r1 - greatest(1.2 * s1, 6)) AS at_right, max(x0) FILTER (no = 1) AS x0, max(x1) FILTER (no = 1) AS x1, max(left_x) FILTER (no = 1) AS lx, max(right_x) FILTER (no = 1) AS rxx, max(text) FILTER (no = 1) AS text,
             max(rx) FILTER (no = 1) AS rx1, max(rx) FILTER (no = 2) AS rx2, max(page) FILTER (no = 1) AS src_page, max(y0) FILTER (no = 1) AS src_y0, max(big) FILTER (no = 1) AS big, max(size) FILTER (no = 1) AS fsize, median(dy) FILTER (same AND dy > 0) AS pitch, max(page) AS src_last, arg_max(y0, ord) AS last_y FROM h GROUP BY doc_id, line_no),
f AS (SELECT g.*, w.n_whole, w.size, base, n <= 2 AND at_right AND x0 > lx + 0.3 * (rxx - lx) AND n_whole = n AS r FROM g JOIN (SELECT doc_id, line_no, count(*) AS n_whole, median(size) AS size FROM p GROUP BY 1, 2) w ON w.doc_id = g.doc_id AND w.line_no = g.line_no JOIN b ON b.doc_id = g.doc_id),
c AS (SELECT *, NOT r AND n_whole = 1 AND abs((x0 - lx) - (rxx - x1)) < 0.04 * (rxx - lx) AND x0 > lx + 0.15 * (rxx - lx) AS c,
             CAST(coalesce(CASE WHEN round_even(pitch / greatest(size, big) * 100, 0) < 105 THEN round_even(pitch / size * 100, 0) ELSE round_even(pitch / greatest(size, big) * 100, 0) END, 0) AS INTEGER) AS line_pct FROM f)
SELECT doc_id, line_no, CASE WHEN r THEN 'RIGHT' WHEN c THEN 'CENTER' ELSE 'LEFT' END AS align, CASE WHEN n_whole = 1 AND text = '[A]' THEN 'label' WHEN r AND trim(text) LIKE '-%' THEN 'credit' ELSE '' END AS role,
       CASE WHEN r OR c THEN 0.0 WHEN n >= 2 THEN round_even((rx1 - rx2) * 10, 0) / 10 WHEN rx1 - base > 0.4 * fsize THEN round_even((rx1 - base) * 10, 0) / 10 ELSE 0.0 END AS indent, line_pct, src_page, src_y0,
       last_y + CASE WHEN line_pct > 0 THEN line_pct ELSE 155 END / 100.0::DOUBLE * size AS src_y1, src_last FROM c""", ("text_lines",))
def _(spark, folder):
    # some lines start further right, some end at the right bound or stand in the middle, some are pieces on a row
    lines = text_lines(spark, folder)
    head, no = F.col("wrap") == 0, F.col("line_no")
    beside = ~head & (F.col("ord") % 11 == 0)
    shift = F.when(head & (no % 3 == 0), 10.0).when((F.length("text") < 30) & (no % 3 == 1), (F.col("right") - F.col("x1")) / F.when(no % 2 == 0, 2.0).otherwise(1.0)).otherwise(0.0)
    lines = lines.withColumns({
        "y0": F.col("y0") - F.when(beside, 13).otherwise(0), "x0": F.when(beside, F.lit(300.0) + F.col("col") * 270).otherwise(F.col("x0") + shift),
        "x1": F.when(beside, F.lit(310.0) + F.col("col") * 270).otherwise(F.col("x1") + shift), "text": F.when(no % 13 == 5, "[A]").when(no % 13 == 6, F.concat(F.lit("- "), "text")).otherwise(F.col("text")),
        "big": F.when(head & (no % 5 == 0), 16.0).when(head & (no % 5 == 1), 12.0).otherwise(F.col("size"))})
    return ops.para_metrics(lines, ["doc_id", "line_no"], ["doc_id"])


@query("letter_spacing", "D15", """
SELECT doc_id, line_no, CASE WHEN v <= -2 THEN greatest(-20, v) ELSE 0 END AS spacing FROM (
 SELECT doc_id, line_no, CAST(round_even(min(((5.0 * (n - 1) + le / 1000.0 * size) - em / 1000.0 * size) / (n * size)) * 100, 0) AS INTEGER) AS v
 FROM (SELECT doc_id, line_no, size, length(t) AS n, em(t) AS em, em(substr(t, -1, 1)) AS le FROM (SELECT *, trim(text) AS t FROM layout_rows))
 WHERE n >= 8 GROUP BY doc_id, line_no)""".replace("em(t)", "EM_T").replace("em(substr(t, -1, 1))", "EM_L").replace("EM_T", "{0}").replace("EM_L", "{1}").format(*[
    f"list_sum(list_transform(string_split({t}, ''), lambda c: CASE WHEN c = ' ' THEN 260 WHEN c IN ('.', ',') THEN 250 WHEN c = '''' THEN 220 "
    "WHEN c IN ('(', ')') THEN 346 WHEN c IN ('[', ']') THEN 360 WHEN c IN (':', ';') THEN 286 WHEN c = '-' THEN 310 WHEN c = '!' THEN 330 "
    "WHEN c = '?' THEN 470 WHEN c = '\"' THEN 410 WHEN ascii(c) < 128 THEN 560 ELSE 800 END))" for t in ("t", "substr(t, -1, 1)")]), ("layout_rows",))
def _(spark, folder):
    t = F.trim("text")
    rows = corpus.layout_rows(spark, folder).select(
        "doc_id", "line_no", t.alias("text"), F.lit(0.0).alias("first_x"), ((F.length(t) - 1) * 5.0).alias("last_x"), "size",
        F.lit(True).alias("uniform"), F.lit(False).alias("overlap"))
    return ops.letter_spacing(rows, ["doc_id", "line_no"])


@query("line_segments", "D16", """
SELECT doc_id, ord, CAST(sum(cut) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS segment FROM (
 SELECT doc_id, ord, CASE WHEN ord * 30.0 - lag(ord * 30.0 + l_quantity / 2) OVER (PARTITION BY doc_id ORDER BY ord) > 12 THEN 1 ELSE 0 END AS cut FROM numbers)""", ("numbers",))
def _(spark, folder):
    g = corpus.numbers(spark, folder).select("doc_id", "ord", F.col("ord").alias("gno"), (F.col("ord") * 30.0).alias("x0"),
                                             (F.col("ord") * 30.0 + F.col("l_quantity") / 2).alias("x1"), F.lit(10.0).alias("size"))
    return ops.segments_in_line(g, ["doc_id"]).select("doc_id", "ord", F.col("segment").cast("long"))


@query("boxes_typed", "D17", """
SELECT doc_id, title, CASE WHEN title LIKE '%조건%' THEN '조건' WHEN title LIKE '%보기%' OR title = '' THEN '보기' ELSE '기타' END AS kind, diagram,
       NOT diagram AND wide AND parts = 0 AND li > 0 AND ri > 0 AND li + ri = n AS two_columns
FROM (SELECT *, CASE WHEN shown AND wide THEN drawings >= 2 * n OR framed >= greatest(2, 0.3 * n) ELSE shown END AS diagram
      FROM (SELECT *, drawings >= 4 OR (wide AND images >= 2) AS shown FROM (
            SELECT doc_id, CASE arg_min(l_returnflag, ord) WHEN 'A' THEN '<보 기>' WHEN 'N' THEN '<조건>' ELSE '' END AS title,
                   sum(number)::BIGINT // 4 AS drawings, count(*) AS n, count(*) FILTER (l_discount > 0.07) AS framed, count(*) FILTER (l_linestatus = 'F') AS images,
                   doc_id % 2 = 0 AS wide, doc_id % 3 AS parts, count(*) FILTER (l_quantity < 25) AS li, count(*) FILTER (l_quantity > 27) AS ri FROM numbers GROUP BY doc_id)))""".replace("'<보 기>' WHEN", "'<보기>' WHEN"), ("numbers",))
def _(spark, folder):
    first = F.min_by("l_returnflag", "ord")
    boxes = corpus.numbers(spark, folder).groupBy("doc_id").agg(
        F.when(first == "A", " 〈 보기 ＞").when(first == "N", "<조건>").otherwise("글").alias("first_text"), F.floor(F.sum("number") / 4).alias("drawings"),
        F.count("*").alias("lines"), F.count_if(F.col("l_discount") > 0.07).alias("framed"), F.count_if(F.col("l_linestatus") == "F").alias("images"),
        (F.col("doc_id") % 2 == 0).alias("wide"), (F.col("doc_id") % 3).alias("parts"), F.count_if(F.col("l_quantity") < 25).alias("left_items"),
        F.count_if(F.col("l_quantity") > 27).alias("right_items"), F.count("*").alias("items"))
    return ops.type_boxes(boxes).select("doc_id", "title", "kind", "diagram", "two_columns")


@query("bracket_rows", "D18", """
SELECT doc_id, page, row, count(*) FILTER (x0 < bx) AS left, count(*) FILTER (x0 >= bx) AS right, least(min(by0), min(y0)) AS top, greatest(max(by1), max(y1)) AS bottom
FROM (SELECT l.doc_id, l.page, l.sid, l.x0, l.y0, l.y1, b.sid AS row, b.x0 AS bx, b.y0 AS by0, b.y1 AS by1,
             row_number() OVER (PARTITION BY l.doc_id, l.page, l.sid ORDER BY CASE WHEN (l.y0 + l.y1) / 2 BETWEEN b.y0 - 2 AND b.y1 + 2 THEN 0
               ELSE least(abs((l.y0 + l.y1) / 2 - b.y0), abs((l.y0 + l.y1) / 2 - b.y1)) END, b.sid) AS k
      FROM shapes l JOIN shapes b ON l.doc_id = b.doc_id AND l.page = b.page AND b.flag = 'A' AND b.status = 'O' WHERE NOT (l.flag = 'A' AND l.status = 'O'))
WHERE k = 1 GROUP BY doc_id, page, row""", ("shapes",))
def _(spark, folder):
    s = corpus.shapes(spark, folder)
    is_bracket = (F.col("flag") == "A") & (F.col("status") == "O")
    brackets = s.where(is_bracket).select("doc_id", "page", F.col("sid").alias("row"), F.col("x0").alias("x"), "y0", "y1")
    lines = s.where(~is_bracket).select("doc_id", "page", F.col("sid").alias("lid"), "x0", "y0", "y1")
    return ops.bracket_rows(brackets, lines, ["doc_id", "page"])


TOKENS = """tok AS (SELECT doc_id, ord, CASE WHEN l_returnflag <> 'R' THEN number ELSE 0 END AS digit, l_quantity / 2 AS gap FROM numbers),
t2 AS (SELECT *, coalesce(max(CASE WHEN digit = 0 AND pd = 0 THEN gap END) OVER (PARTITION BY doc_id), 0) AS plain
       FROM (SELECT *, lag(digit) OVER (PARTITION BY doc_id ORDER BY ord) AS pd FROM tok))"""


@query("choices_split", "D19", f"""
WITH RECURSIVE {TOKENS},
walk AS (
 SELECT doc_id, ord, CASE WHEN digit > 0 THEN digit + 1 ELSE 0 END AS want, 0 AS choice FROM t2 WHERE ord = 1
 UNION ALL
 SELECT t.doc_id, t.ord, CASE WHEN cut THEN t.digit + 1 ELSE want END, choice + CASE WHEN cut THEN 1 ELSE 0 END
 FROM (SELECT w.want, w.choice, t2.*, t2.digit > 0 AND (t2.gap >= 15 OR (t2.digit = w.want AND t2.gap >= 6 AND t2.gap >= 1.6 * t2.plain)) AS cut
       FROM walk w JOIN t2 ON t2.doc_id = w.doc_id AND t2.ord = w.ord + 1) t)
SELECT doc_id, ord, CAST(choice AS BIGINT) AS choice FROM walk""", ("numbers",))
def _(spark, folder):
    tokens = corpus.numbers(spark, folder).select(
        "doc_id", "ord", F.when(F.col("l_returnflag") != "R", digit(F.col("number"))).otherwise("x").alias("c"),
        (F.col("l_quantity") / 2).alias("gap"), F.lit(10.0).alias("size"))
    return ops.split_choices(tokens, ["doc_id"]).select("doc_id", "ord", F.col("choice").cast("long"))


def question_items(spark, folder):
    n = corpus.numbers(spark, folder)
    q = F.floor(F.col("doc_id") / 2)
    line = F.col("l_discount") < 0.09
    return n.select(q.alias("question"), F.struct("doc_id", "number").alias("chunk"), (F.col("doc_id").cast("long") % 2 * 1_000_000_000 + F.col("ord")).alias("ord"),
                    F.when(line, "line").otherwise("other").alias("kind"), (line & (F.col("l_returnflag") != "R")).alias("mark"),
                    (F.col("l_quantity") > 45).alias("part"), (F.col("l_quantity") < 10).alias("far"), (F.col("l_partkey") % 2 == 0).alias("p_full"),
                    (F.col("l_partkey") % 5 == 0).alias("sub"), (F.col("l_quantity") > 30).alias("writes"), (F.col("l_partkey") % 7 == 0).alias("credit"))


QUESTION_WALK = """
WITH RECURSIVE it AS (
 SELECT doc_id // 2 AS question, CAST(doc_id AS BIGINT) % 2 * 1000000000 + ord AS ord, l_discount < 0.09 AS line, l_discount < 0.09 AND l_returnflag <> 'R' AS mark, l_quantity > 45 AS part,
        l_quantity < 10 AS far, l_partkey % 2 = 0 AS p_full, l_partkey % 5 = 0 AS sub, l_quantity > 30 AS writes, l_partkey % 7 = 0 AS credit FROM numbers),
seq AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord) AS k FROM it),
walk AS (
 SELECT DISTINCT question, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ord, 'stem' AS state, 0 AS marks, true AS all_write FROM seq
 UNION ALL
 SELECT question, k, ord, ns, marks + CASE WHEN ns = 'choices' AND mark THEN 1 ELSE 0 END, all_write AND (NOT (ns = 'choices' AND mark) OR writes)
 FROM (SELECT s.*, w.marks, w.all_write, CASE WHEN w.state = 'after' THEN 'after'
   WHEN NOT s.line THEN CASE WHEN w.state = 'choices' AND (w.marks >= 5 OR w.all_write) THEN 'after' WHEN w.state = 'choices' THEN 'choices' ELSE 'blocks' END
   WHEN s.mark THEN 'choices'
   WHEN w.state = 'choices' THEN CASE WHEN NOT s.credit AND w.marks >= 5 AND (s.far OR NOT s.p_full) AND NOT s.sub THEN 'after' ELSE 'choices' END
   WHEN w.state = 'stem' AND s.part THEN 'blocks' ELSE w.state END AS ns
  FROM walk w JOIN seq s ON s.question = w.question AND s.k = w.k + 1))
"""


@query("question_parts", "D20", QUESTION_WALK + """
SELECT w.question, w.ord, CASE WHEN w.state = 'choices' AND NOT line THEN 'blocks' ELSE w.state END AS state FROM walk w JOIN seq s ON s.question = w.question AND s.k = w.k""", ("numbers",))
def _(spark, folder):
    return ops.assemble_questions(question_items(spark, folder)).select("question", "ord", "state")


def question_details(items, n):
    """Items with what the details of a question look at."""
    return items.join(n.select(F.floor(F.col("doc_id") / 2).alias("question"), (F.col("doc_id").cast("long") % 2 * 1_000_000_000 + F.col("ord")).alias("ord"),
        (F.col("doc_id") % 2 * 10 + F.floor(F.col("number") / 3)).alias("page"), (F.floor(F.col("doc_id") / 2) % 3 != 0).alias("last"), (F.col("l_suppkey") % 3 + 1).alias("segments"),
        F.col("l_quantity").alias("chars"), (F.col("l_suppkey") % 2 == 0).alias("full"), (F.col("l_suppkey") % 5 < 2).alias("marker"), (F.col("l_suppkey") % 5 == 3).alias("arrow")), ["question", "ord"])


@query("question_tail_dropped", "D20", """
WITH RECURSIVE it AS (
 SELECT doc_id // 2 AS question, CAST(doc_id AS BIGINT) % 2 * 1000000000 + ord AS ord, l_discount < 0.09 AS line, l_discount < 0.09 AND l_returnflag <> 'R' AS mark, l_quantity > 45 AS part,
        l_quantity < 10 AS far, l_partkey % 2 = 0 AS p_full, l_partkey % 5 = 0 AS sub, l_quantity > 30 AS writes, l_partkey % 7 = 0 AS credit, doc_id % 2 * 10 + number // 3 AS page, doc_id // 2 % 3 <> 0 AS last FROM numbers),
seq AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord) AS k FROM it),
walk AS (
 SELECT DISTINCT question, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ord, 'stem' AS state, 0 AS marks, true AS all_write, CAST(-1 AS BIGINT) AS most, false AS gone FROM seq
 UNION ALL
 SELECT question, k, ord, CASE WHEN gone THEN state ELSE ns END, marks + CASE WHEN NOT gone AND ns = 'choices' AND mark THEN 1 ELSE 0 END, all_write AND (gone OR NOT (ns = 'choices' AND mark) OR writes),
        CASE WHEN NOT gone AND ns = 'choices' AND line AND (mark OR NOT credit) THEN greatest(most, page) ELSE most END, gone
 FROM (SELECT s.*, w.marks, w.all_write, w.state, w.most, s.last AND w.marks >= 5 AND s.page > w.most AS gone, CASE WHEN w.state = 'after' THEN 'after'
   WHEN NOT s.line THEN CASE WHEN w.state = 'choices' AND (w.marks >= 5 OR w.all_write) THEN 'after' WHEN w.state = 'choices' THEN 'choices' ELSE 'blocks' END
   WHEN s.mark THEN 'choices'
   WHEN w.state = 'choices' THEN CASE WHEN NOT s.credit AND w.marks >= 5 AND (s.far OR NOT s.p_full) AND NOT s.sub THEN 'after' ELSE 'choices' END
   WHEN w.state = 'stem' AND s.part THEN 'blocks' ELSE w.state END AS ns
  FROM walk w JOIN seq s ON s.question = w.question AND s.k = w.k + 1))
SELECT question, ord, gone AS dropped FROM walk WHERE k > 0""", ("numbers",))
def _(spark, folder):
    items = question_details(question_items(spark, folder), corpus.numbers(spark, folder))
    return ops.behind_last(ops.assemble_questions(items)).select("question", "ord", "dropped")


DETAILS = QUESTION_WALK + """,
det AS (SELECT doc_id // 2 AS question, CAST(doc_id AS BIGINT) % 2 * 1000000000 + ord AS ord, l_suppkey % 3 + 1 AS segments, l_quantity AS chars, l_suppkey % 2 = 0 AS own_full, l_suppkey % 5 < 2 AS marker, l_suppkey % 5 = 3 AS arrow FROM numbers),
st AS (SELECT s.*, d.segments, d.chars, d.own_full, d.marker, d.arrow, CASE WHEN w.state = 'choices' AND NOT line THEN 'blocks' ELSE w.state END AS state, w.marks
       FROM walk w JOIN seq s ON s.question = w.question AND s.k = w.k JOIN det d ON d.question = s.question AND d.ord = s.ord),
roles AS (SELECT *, CASE WHEN line AND state = 'blocks' AND segments >= 2 AND chars <= 40 AND coalesce(lead(line AND mark AND state = 'choices' AND marks = 1) OVER (PARTITION BY question ORDER BY k), false) THEN 'header'
       WHEN line AND state = 'choices' AND NOT mark AND credit THEN 'credit' ELSE '' END AS role FROM st)"""


@query("question_line_roles", "D20", DETAILS + """
SELECT question, ord, role FROM roles""", ("numbers",))
def _(spark, folder):
    items = question_details(question_items(spark, folder), corpus.numbers(spark, folder))
    return ops.question_roles(ops.assemble_questions(items)).select("question", "ord", "role")


@query("choice_paragraphs", "D20", DETAILS + """,
c AS (SELECT question, marks, ord, own_full, writes, marker, arrow, row_number() OVER (PARTITION BY question, marks ORDER BY ord) AS m FROM roles WHERE line AND state = 'choices' AND role = ''),
parts AS (SELECT question, marks, ord, m, own_full, writes, false AS cut, false AS arrowed, 0 AS part FROM c WHERE m = 1
 UNION ALL
 SELECT n.question, n.marks, n.ord, n.m, n.own_full, n.writes, p.cut OR hit, CASE WHEN NOT (p.cut OR hit) THEN false WHEN n.arrow THEN true WHEN n.marker THEN false ELSE p.arrowed END,
        CASE WHEN NOT (p.cut OR hit) THEN 0 WHEN n.marker OR n.arrow OR NOT p.arrowed THEN p.part + 1 ELSE p.part END
 FROM parts p JOIN c n ON n.question = p.question AND n.marks = p.marks AND n.m = p.m + 1, LATERAL (SELECT (n.marker OR n.arrow) AND (NOT p.own_full OR p.writes) AS hit))
SELECT question, CAST(marks AS BIGINT) AS choice, ord, CAST(part AS BIGINT) AS part FROM parts""", ("numbers",))
def _(spark, folder):
    items = question_details(question_items(spark, folder), corpus.numbers(spark, folder))
    roles = ops.question_roles(ops.assemble_questions(items))
    return ops.choice_parts(roles.where("kind = 'line' AND state = 'choices' AND role = ''")).select("question", "choice", "ord", "part")


@query("question_types", "D20", """
SELECT doc_id, CASE WHEN bool_and(l_quantity > 30) THEN 'subjective' ELSE 'objective' END AS qtype FROM numbers GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    return ops.question_type(corpus.numbers(spark, folder).withColumn("writes", F.col("l_quantity") > 30), ["doc_id"])


def grid_segments(spark, folder):
    orders = table(spark, folder, "orders")
    rows = orders.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice"))
    k = (F.col("o_custkey") + F.when((F.col("o_custkey") % 5 == 0) & (F.col("choice") == 3), 1).otherwise(0)) % 3 + 1
    rows = rows.withColumn("seg", F.explode(F.sequence(F.lit(0), (k - 1).cast("int"))))
    x0 = F.lit(60.0) + F.col("seg") * 100 + (F.col("o_orderkey") * 7 + F.col("choice") * 13 + F.col("seg") * 5) % 26
    return rows.select(F.col("o_orderkey").alias("question"), "choice", "seg", x0.alias("x0"), F.lit(10.0).alias("size"), F.col("o_custkey").alias("cust"))


sql_view("grid_segments", """
SELECT question, choice, seg, 60.0::DOUBLE + seg * 100 + (question * 7 + choice * 13 + seg * 5) % 26 AS x0, cust
FROM (SELECT question, cust, choice, unnest(range((cust + CASE WHEN cust % 5 = 0 AND choice = 3 THEN 1 ELSE 0 END) % 3 + 1)) AS seg
      FROM (SELECT o_orderkey AS question, o_custkey AS cust, unnest(range(4)) AS choice FROM orders))""")
GRID = """grid AS (SELECT g.question, c.seg, c.col_x, r.rows, r.k FROM
 (SELECT question, count(*) AS rows, min(k) AS k FROM (SELECT question, choice, count(*) AS k FROM grid_segments GROUP BY ALL) GROUP BY question HAVING min(k) = max(k) AND min(k) >= 2) r
 JOIN (SELECT s.question FROM grid_segments s JOIN (SELECT question, seg, median(x0) AS col_x FROM grid_segments GROUP BY ALL) m ON s.question = m.question AND s.seg = m.seg
       GROUP BY s.question HAVING max(abs(s.x0 - col_x)) <= 15) g ON g.question = r.question
 JOIN (SELECT question, seg, median(x0) AS col_x FROM grid_segments GROUP BY ALL) c ON c.question = r.question)"""


@query("choice_grids", "D21", f"WITH {GRID} SELECT question, CAST(seg AS INTEGER) AS seg, col_x, rows, k FROM grid", ("grid_segments",))
def _(spark, folder):
    return ops.choice_grid(grid_segments(spark, folder), ["question"])


@query("choice_grid_headers", "D21", f"""
WITH {GRID}, heads AS (SELECT DISTINCT question, seg AS piece, 45.0::DOUBLE + seg * 95 AS x0, 'h' || seg AS text FROM grid_segments WHERE choice = 0),
near AS (SELECT question, piece, arg_min(seg, (d, seg)) AS seg, any_value(text) AS text FROM (
         SELECT h.question, piece, g.seg, abs(h.x0 - col_x) AS d, text FROM heads h JOIN grid g ON g.question = h.question) GROUP BY question, piece),
cnt AS (SELECT question, seg, count(*) AS n, any_value(text) AS text FROM near GROUP BY question, seg)
SELECT question, CAST(seg AS INTEGER) AS seg, text FROM cnt WHERE question NOT IN (SELECT question FROM cnt WHERE n > 1)""", ("grid_segments",))
def _(spark, folder):
    segs = grid_segments(spark, folder)
    heads = segs.where("choice = 0").select("question", F.col("seg").alias("piece"), (F.lit(45.0) + F.col("seg") * 95).alias("x0"),
                                            F.concat(F.lit("h"), F.col("seg").cast("string")).alias("text"))
    return ops.grid_header(ops.choice_grid(segs, ["question"]), heads, ["question"])


def answer_lines(spark, folder):
    t = corpus.turns(spark, folder).where("kind <> 'guide'")
    text = F.when((F.col("kind") == "question") & (F.col("number") % 2 == 0), F.concat(F.lit("[해설] "), "text")).otherwise(F.col("text"))
    rows = t.select("doc_id", "chunk", F.col("ord").alias("turn"), F.posexplode(F.split(text, "\n")).alias("ln", "text"))
    return rows.select("doc_id", F.struct("chunk", "turn").alias("chunk"), (F.col("turn").cast("long") * 1_000_000_000 + F.col("ln")).alias("ord"), "text", (F.length("text") > 60).alias("full"))


sql_view("answer_lines", """
SELECT doc_id, CAST(turn AS BIGINT) * 1000000000 + CAST(unnest(range(len(ls))) AS INTEGER) AS ord, unnest(ls) AS text FROM (
 SELECT doc_id, ord AS turn, string_split(CASE WHEN kind = 'question' AND number % 2 = 0 THEN '[해설] ' || text ELSE text END, chr(10)) AS ls FROM turns WHERE kind <> 'guide')""", ("turns",))


@query("answers_parsed", "D22", """
SELECT doc_id, ord, entry, number, max(starts) OVER (PARTITION BY doc_id, entry ORDER BY ord) = 1 AS in_body FROM (
 SELECT *, CAST(sum(head) OVER w AS BIGINT) AS entry, last_value(CASE WHEN head = 1 THEN n END IGNORE NULLS) OVER w AS number,
        CASE WHEN head = 0 AND (regexp_matches(text, '^\\s*\\[\\s*해설\\s*\\]') OR NOT p_full) THEN 1 ELSE 0 END AS starts
 FROM (SELECT *, CASE WHEN regexp_matches(text, '^\\s*\\d{1,3}\\s*\\)\\s*\\[?\\s*정답') THEN 1 ELSE 0 END AS head,
              TRY_CAST(regexp_extract(text, '^\\s*(\\d{1,3})\\s*\\)\\s*\\[?\\s*정답', 1) AS INTEGER) AS n,
              lag(length(text) > 60) OVER (PARTITION BY doc_id ORDER BY ord) AS p_full FROM answer_lines)
 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE entry > 0""".replace("\\\\", "\\"), ("answer_lines",))
def _(spark, folder):
    return ops.parse_answers(answer_lines(spark, folder)).select("doc_id", "ord", "entry", "number", "in_body")


@query("answer_headings", "D22", """
SELECT text, CASE WHEN length(trim(text)) BETWEEN 1 AND 16 AND NOT regexp_matches(trim(text), '[.?!다]$') AND NOT regexp_matches(trim(text), '^[A-Z]\\s*\\.')
       THEN 'heading' ELSE '' END AS role, count(*) AS n FROM doc_lines GROUP BY text""".replace("\\\\", "\\"), ("doc_lines",))
def _(spark, folder):
    return ops.answer_headings(corpus.doc_lines(spark, folder)).groupBy("text", "role").agg(F.count("*").alias("n"))


@query("answers_linked", "D23", """
SELECT q.doc_id, q.number, coalesce(regexp_replace(a.text, '^\\d+\\) \\[정답\\]\\s*', ''), '') AS answer FROM turns q
LEFT JOIN turns a ON a.doc_id = q.doc_id AND a.number = q.number AND a.kind = 'answer' WHERE q.kind = 'question'""".replace("\\\\", "\\"), ("turns",))
def _(spark, folder):
    t = corpus.turns(spark, folder)
    return ops.link_answers(t.where("kind = 'question'").select("doc_id", "number"),
                            t.where("kind = 'answer'").select("doc_id", "number", "ord", F.col("text").alias("head")))


@query("negatives_underlined", "D24", """
SELECT doc_id, ord, CASE WHEN bool_or(hit) OVER (PARTITION BY doc_id) THEN len(ws) ELSE 0 END AS words FROM (
 SELECT doc_id, ord, ws, length(text) % 4 = 0 AND len(ws) > 0 AS hit FROM (SELECT *, list_filter(range(1, len(tk)), lambda i: regexp_matches(tk[i], '\\b(of|in|the)$') AND tk[i + 1] LIKE 'th%') AS ws
  FROM (SELECT *, string_split(text, ' ') AS tk FROM turns)))""".replace("\\\\", "\\"), ("turns",))
def _(spark, folder):
    stems = corpus.turns(spark, folder).select("doc_id", "ord", "text", (F.length("text") % 4 == 0).alias("underlined"))
    return ops.underline_negatives(stems, r"\b(of|in|the)(?= th)").select("doc_id", "ord", F.size("words").cast("long").alias("words"))


@query("negative_runs_underlined", "D24", """
WITH s AS (SELECT doc_id, ord, number % 4 AS kind, bool_or(number % 4 = 3 AND l_quantity > 40) OVER (PARTITION BY doc_id) AS uses, l_quantity > 40 AS lined, l_returnflag AS look FROM numbers)
SELECT doc_id, ord, CASE kind
  WHEN 0 THEN CASE WHEN uses THEN '옳지 /A|않은_/A| 것/A|은?/B' ELSE '옳지 않 은 것/A|은?/B' END
  WHEN 1 THEN CASE WHEN uses THEN '적절하지 /A|않는_/A| 것은?/A' ELSE '적절하지않/A|는/B| 것은?/A' END
  WHEN 2 THEN '아닌가/A| 것은?/B'
  ELSE CASE WHEN uses THEN '답이 /A|아닌_/B|것은?/A' WHEN lined THEN '' ELSE '답이 /A|아닌/B|것은?/A' END END AS runs FROM s""", ("numbers",))
def _(spark, folder):
    # look B marks other weights; a stem of the fourth kind has its word underlined where the quantity is over 40
    n = corpus.numbers(spark, folder).select("doc_id", "ord", "l_quantity", (F.col("number") % 4).alias("kind"))
    n = n.repartition(corpus.pieces(spark, folder, "lineitem", 1 << 20), "doc_id")
    run = lambda k, text, look, lined=False: F.struct(F.lit(k).alias("run"), F.lit(text).alias("text"), F.lit(look).alias("look"), (F.lit(lined) & (F.col("l_quantity") > 40)).alias("underline"))
    parts = (F.when(F.col("kind") == 0, F.array(run(1, "옳지 않", "A"), run(2, " 은 것", "A"), run(3, "은?", "B"))).when(F.col("kind") == 1, F.array(run(1, "적절하지않", "A"), run(2, "는", "B"), run(3, " 것은?", "A")))
             .when(F.col("kind") == 2, F.array(run(1, "아닌가", "A"), run(2, " 것은?", "B"))).otherwise(F.array(run(1, "답이 ", "A"), run(2, "아닌", "B", True), run(3, "것은?", "A"))))
    runs = n.select("doc_id", F.col("ord").alias("stem"), F.explode(parts).alias("r")).select("doc_id", "stem", "r.*")
    out = ops.underline_runs(runs)
    shown = F.concat("text", F.when(F.col("underline"), "_").otherwise(""), F.lit("/"), "look")
    return out.groupBy("doc_id", F.col("stem").alias("ord")).agg(ops.ordered_concat(["run"], shown, "|").alias("runs"))


@query("image_rows", "D25", """
WITH RECURSIVE im AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY sid) AS k, floor(y0 / 200) * 200 AS top FROM shapes),
walk AS (
 SELECT doc_id, page, sid, k, [{'a': x0 / 8, 'b': x0 / 8 + 40, 'c': top + y0 / 20, 'd': top + y0 / 20 + 60}] AS members, 1 AS row FROM im WHERE k = 1
 UNION ALL
 SELECT doc_id, page, sid, k, CASE WHEN fits THEN list_append(members, me) ELSE [me] END, row + CASE WHEN fits THEN 0 ELSE 1 END FROM (
  SELECT n.doc_id, n.page, n.sid, n.k, w.members, w.row, {'a': x0 / 8, 'b': x0 / 8 + 40, 'c': top + y0 / 20, 'd': top + y0 / 20 + 60} AS me,
   len(list_filter(w.members, lambda m: least(m.d, n.top + n.y0 / 20 + 60) - greatest(m.c, n.top + n.y0 / 20) > 0.5 * least(m.d - m.c, (n.top + n.y0 / 20 + 60) - (n.top + n.y0 / 20))
       AND least(m.b, n.x0 / 8 + 40) - greatest(m.a, n.x0 / 8) < 0.25 * least(m.b - m.a, (n.x0 / 8 + 40) - n.x0 / 8))) = len(w.members) AS fits
  FROM walk w JOIN im n ON n.doc_id = w.doc_id AND n.page = w.page AND n.k = w.k + 1))
SELECT doc_id, page, sid, CAST(row AS BIGINT) AS row FROM walk""".replace("x0 / 8", "part % 400"), ("shapes",))
def _(spark, folder):
    s = corpus.shapes(spark, folder)
    x = (F.col("part") % 400).cast("double")
    y = F.floor(F.col("y0") / 200) * 200 + F.col("y0") / 20
    images = s.select("doc_id", "page", "sid", F.col("sid").alias("ord"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 60).alias("y1"))
    return ops.image_rows(images, ["doc_id", "page"]).select("doc_id", "page", "sid", F.col("row").cast("long"))


@query("table_rows", "D26", """
SELECT doc_id, page, sid, CAST(sum(n) OVER (PARTITION BY doc_id, page ORDER BY sid) AS BIGINT) AS row FROM (
 SELECT doc_id, page, sid, CASE WHEN y0 < lag(y1) OVER w - 2 AND y1 > lag(y0) OVER w + 2 AND x0 >= lag(x1) OVER w - 2 THEN 0 ELSE 1 END AS n
 FROM shapes WINDOW w AS (PARTITION BY doc_id, page ORDER BY sid))""", ("shapes",))
def _(spark, folder):
    s = corpus.shapes(spark, folder).withColumn("ord", F.col("sid"))
    return ops.table_rows(s, ["doc_id", "page"]).select("doc_id", "page", "sid", F.col("row").cast("long"))


@query("cell_alignment", "D26", """
SELECT doc_id, l_returnflag AS cell, CASE WHEN bool_and(abs((x0 - 36) - (306 - x1)) <= greatest(4, 0.12 * 270)) THEN 'CENTER' ELSE 'LEFT' END AS align
FROM number_lines GROUP BY doc_id, l_returnflag""", ("number_lines",))
def _(spark, folder):
    lines = number_lines(spark, folder).withColumns({"cell": F.col("l_returnflag"), "cell_x0": F.lit(36.0), "cell_x1": F.lit(306.0)})
    return ops.cell_align(lines, ["doc_id", "cell"])


@query("relative_sizes", "D27", """
SELECT doc_id, ord, CASE WHEN l_quantity > 0 THEN round_even(l_quantity / body * 100, 0) / 100 ELSE 1.0 END AS rel FROM numbers
JOIN (SELECT doc_id, median(l_quantity) AS body FROM numbers GROUP BY doc_id) USING (doc_id)""", ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder)
    body = n.groupBy("doc_id").agg(F.median("l_quantity").alias("body"))
    return ops.rel_size(n.join(body, "doc_id").withColumn("size", F.col("l_quantity"))).select("doc_id", "ord", "rel")


@query("source_gaps", "D28", """
SELECT doc_id, ord, coalesce(CASE WHEN pp = page AND y > pe THEN CASE WHEN wide THEN g ELSE least(g, 3.0) END ELSE 0.0 END, 0.0) AS gap,
       coalesce(pp = page AND NOT y > pe AND y < pe - 30 AND NOT wide, false) AS col_break
FROM (SELECT *, round_even((y - pe) / 10 * 100, 0) / 100 AS g FROM (
      SELECT doc_id, ord, number // 4 AS page, l_partkey % 97 * 1.0::DOUBLE AS y, l_returnflag = 'A' AS wide,
             lag(number // 4) OVER w AS pp, lag(l_partkey % 97 * 1.0::DOUBLE + l_quantity) OVER w AS pe FROM numbers WINDOW w AS (PARTITION BY doc_id ORDER BY ord)))""", ("numbers",))
def _(spark, folder):
    n = chunked(corpus.numbers(spark, folder))
    y = F.col("l_partkey") % 97 * 1.0
    page = F.floor(F.col("number") / 4)
    paras = n.select("doc_id", "chunk", "ord", page.alias("first_page"), page.alias("last_page"), y.alias("y0"), (y + F.col("l_quantity")).alias("expected"),
                     (F.col("l_returnflag") == "A").alias("wide"), F.lit(10.0).alias("body"))
    return ops.source_gaps(paras).select("doc_id", "ord", "gap", "col_break")


@query("document_stats", "D29", """
SELECT *, answers > 0 AND answers <> questions AS counts_differ FROM (
 SELECT doc_id, count(*) FILTER (kind = 'question') AS questions, count(*) FILTER (kind = 'answer') AS answers, count(*) FILTER (kind = 'guide') AS guides FROM turns GROUP BY doc_id)""", ("turns",))
def _(spark, folder):
    return ops.doc_stats(corpus.turns(spark, folder))


@query("choice_warnings", "D29", """
SELECT doc_id, bool_or(number <> ord) AS bad_order, count(*) NOT IN (4, 5) AND NOT bool_and(l_quantity > 30) AS bad_count FROM numbers GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    choices = corpus.numbers(spark, folder).select("doc_id", F.col("ord").alias("choice_ord"), digit(F.col("number")).alias("label"), (F.col("l_quantity") > 30).alias("writes"))
    return ops.choice_warnings(choices, ["doc_id"])


@query("all_runs", "D30", """
SELECT doc_id, line_no AS para_id, unnest(ws) AS text, CAST(unnest(range(len(ws))) AS INTEGER) AS run_no FROM (SELECT doc_id, line_no, string_split(text, '. ') AS ws FROM doc_lines)""", ("doc_lines",))
def _(spark, folder):
    paras = corpus.doc_lines(spark, folder).select(
        "doc_id", F.col("line_no").alias("para_id"), F.col("line_no").alias("ord"), F.lit(0).alias("depth"),
        F.transform(F.split("text", r"\. "), lambda t: F.struct(t.alias("text"), F.lit(False).alias("underline"))).alias("runs"))
    return ops.all_runs(paras).select("doc_id", "para_id", "run_no", "text")


@query("all_images", "D30", """
SELECT doc_id, ord, number AS depth FROM numbers WHERE l_returnflag = 'N'""", ("numbers",))
def _(spark, folder):
    paras = corpus.numbers(spark, folder).select("doc_id", F.col("ord").alias("para_id"), "ord", F.col("number").alias("depth"),
                                                 F.when(F.col("l_returnflag") == "N", "image").otherwise("text").alias("kind"), F.col("l_partkey").alias("ref"))
    return ops.all_images(paras).select("doc_id", "ord", "depth")


@query("row_starts", "D31", """
SELECT doc_id, ord FROM (SELECT *, lag(y) OVER w AS py, lag(x1) OVER w AS px FROM (SELECT doc_id, ord, ord // 2 * 14 AS y, x0, x1 FROM number_lines)
 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE NOT coalesce(abs(y - py) < 4 AND x0 > px, false)""", ("number_lines",))
def _(spark, folder):
    lines = number_lines(spark, folder).select("doc_id", "ord", F.col("number").alias("page"), F.lit(0).alias("col"), "x0", "x1", "size",
                                               (F.floor(F.col("ord") / 2) * 14.0).alias("y0"))
    return ops.row_starts(lines.withColumn("page", F.lit(1))).select("doc_id", "ord")


@query("line_bounds", "D32", """
SELECT doc_id, ord, l AS left, r AS right, x0 - l AS rx FROM (
 SELECT n.doc_id, n.ord, n.x0, CASE WHEN n.l_returnflag = 'R' THEN 40.0::DOUBLE ELSE coalesce(b.bx0, 36.0::DOUBLE) END AS l,
        CASE WHEN n.l_returnflag = 'R' THEN 300.0::DOUBLE ELSE coalesce(b.bx1, 306.0::DOUBLE) END AS r
 FROM number_lines n LEFT JOIN (SELECT doc_id, l_linestatus AS st, min(x0) AS bx0, max(x1) AS bx1 FROM number_lines WHERE number = 1 GROUP BY 1, 2) b
 ON b.doc_id = n.doc_id AND b.st = n.l_linestatus)""", ("number_lines",))
def _(spark, folder):
    n = number_lines(spark, folder)
    in_cell = F.col("l_returnflag") == "R"
    lines = n.select("doc_id", "ord", "x0", F.lit(1).alias("page"), F.lit(0).alias("col"), F.col("l_linestatus").alias("box"),
                     F.when(in_cell, 40.0).alias("cell_left"), F.when(in_cell, 300.0).alias("cell_right"))
    boxes = n.where("number = 1").groupBy("doc_id", F.col("l_linestatus").alias("box")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    columns = n.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("col"), F.lit(36.0).alias("left"), F.lit(306.0).alias("right"))
    return ops.line_bounds(lines, boxes, columns).select("doc_id", "ord", "left", "right", "rx")


@query("lines_cut", "D33", """
SELECT doc_id, ord, part, trim(t) AS text, x + 5 * (length(t) - length(ltrim(t))) AS x0, x + 5 * length(rtrim(t)) AS x1 FROM (
 SELECT doc_id, ord, 0 AS part, CASE WHEN ord % 3 = 0 THEN text ELSE substr(text, 1, 20) END AS t, left_x AS x FROM text_lines
 UNION ALL SELECT doc_id, ord, 1, substr(text, 21), left_x + 100 FROM text_lines WHERE ord % 3 <> 0) WHERE trim(t) <> ''""", ("text_lines",))
def _(spark, folder):
    lines = text_lines(spark, folder)
    # left bounds and the pitch are whole points
    x0 = F.sequence(F.col("left").cast("int"), F.col("left").cast("int") + (F.length("text") - 1) * 5, F.lit(5))
    x1 = F.sequence(F.col("left").cast("int") + 5, F.col("left").cast("int") + F.length("text") * 5, F.lit(5))
    glyphs = F.arrays_zip(F.split("text", "").alias("c"), x0.cast("array<double>").alias("x0"), x1.cast("array<double>").alias("x1"))
    rows = lines.select("doc_id", "ord", F.when(F.col("ord") % 3 != 0, 20).alias("cut"), glyphs.alias("glyphs"))
    return ops.cut_lines(rows).select("doc_id", "ord", "part", "text", "x0", "x1")


@query("document_counts", "D29", """
SELECT doc_id, count(*) FILTER (l_returnflag = 'R') AS questions, count(*) FILTER (l_returnflag = 'R' AND l_partkey % 2 = 0) AS objective, count(*) FILTER (l_returnflag = 'R' AND l_partkey % 2 = 1) AS subjective,
       count(*) FILTER (number = 1) AS passages, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS aux_blocks, count(*) FILTER (l_discount > 0.08) AS loose_items, count(*) FILTER (l_quantity > 45) AS dropped_items,
       count(*) FILTER (l_returnflag = 'N') AS answers, count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 3 <> 0) > 0 AND count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 3 <> 0) = count(*) FILTER (l_returnflag = 'N') AS expected_found,
       count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'N') <> count(*) FILTER (l_returnflag = 'R') AS counts_differ
FROM numbers GROUP BY doc_id HAVING count(*) FILTER (l_returnflag IN ('R', 'N') OR number = 1 OR (l_returnflag = 'A' AND l_linestatus = 'F') OR l_discount > 0.08 OR l_quantity > 45) > 0""", ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder)
    questions = n.where("l_returnflag = 'R'").withColumn("qtype", F.when(F.col("l_partkey") % 2 == 0, "objective").otherwise("subjective"))
    return ops.document_stats(questions, n.where("number = 1"), n.where("l_returnflag = 'A' and l_linestatus = 'F'"), n.where("l_discount > 0.08"), n.where("l_quantity > 45"),
                              n.where("l_returnflag = 'N'"), n.where("l_returnflag = 'R' and l_suppkey % 3 <> 0"))


@query("glyph_runs_complete", "D13", """
WITH RECURSIVE g AS (SELECT doc_id, ord, CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE l_returnflag END AS c, l_linestatus = 'F' AS bold, CASE WHEN l_partkey % 5 = 0 THEN '#1' END AS color, CASE WHEN l_suppkey % 7 = 0 THEN 0.0 ELSE round_even((9.8 + l_suppkey % 2 * 0.3) * 2, 0) / 2 END AS size,
           CASE WHEN l_quantity > 15 THEN CASE WHEN l_quantity > 35 THEN '#a' ELSE '#b' END END AS shade, l_discount > 0.02 AS boxed, l_suppkey % 4 = 0 AS underline FROM numbers),
w AS (
 SELECT doc_id, ord, c, bold, color, size, shade, boxed, underline, 1 AS run FROM g WHERE ord = 1
 UNION ALL
 SELECT doc_id, ord, c, bold, color, size, shade, boxed, underline, run + CASE WHEN bold = p.bold AND color IS NOT DISTINCT FROM p.color AND size = p.size AND shade IS NOT DISTINCT FROM p.shade AND boxed = p.boxed AND underline = p.underline THEN 0 ELSE 1 END
 FROM (SELECT n.doc_id, n.ord, n.c, CASE WHEN n.c = ' ' THEN w.bold ELSE n.bold END AS bold, CASE WHEN n.c = ' ' THEN w.color ELSE n.color END AS color, CASE WHEN n.c = ' ' THEN w.size ELSE n.size END AS size,
   CASE WHEN n.c = ' ' THEN CASE WHEN n.shade IS NOT NULL THEN w.shade END ELSE n.shade END AS shade, CASE WHEN n.c = ' ' THEN w.boxed AND n.boxed ELSE n.boxed END AS boxed, n.underline, w.run, w AS p
   FROM w JOIN g n ON n.doc_id = w.doc_id AND n.ord = w.ord + 1))
SELECT doc_id, CAST(run AS BIGINT) AS run, string_agg(c, '' ORDER BY ord) AS text, any_value(bold) AS bold, coalesce(any_value(color), '') AS color, any_value(size) AS size, coalesce(any_value(shade), '') AS shade, any_value(boxed) AS boxed, any_value(underline) AS underline
FROM w GROUP BY doc_id, run""", ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder)
    glyphs = n.select("doc_id", F.col("ord").alias("gno"), F.when(F.col("l_partkey") % 3 == 0, " ").otherwise(F.col("l_returnflag")).alias("c"), (F.col("l_suppkey") % 4 == 0).alias("underline"), (F.col("l_linestatus") == "F").alias("bold"),
                      F.when(F.col("l_partkey") % 5 == 0, "#1").alias("color"), (F.lit(9.8) + F.col("l_suppkey") % 2 * 0.3).alias("size"), (F.col("l_suppkey") % 7 == 0).alias("icon"),
                      F.when(F.col("l_quantity") > 35, "#a").when(F.col("l_quantity") > 15, "#b").alias("shade"), (F.col("l_discount") > 0.02).alias("boxed"))
    out = ops.glyph_runs(glyphs, ["doc_id"])
    return out.select("doc_id", F.col("run").cast("long").alias("run"), "text", "bold", F.coalesce("color", F.lit("")).alias("color"), "size", F.coalesce("shade", F.lit("")).alias("shade"), "boxed", "underline")


@query("row_pieces_joined", "D12", f"""
SELECT doc_id, line_no, string_agg(piece, '' ORDER BY ord) AS text FROM (
 SELECT t.doc_id, line_no, ord, CASE WHEN wrap = min(wrap) OVER w1 THEN text WHEN NOT reliable OR lag(trailing_space) OVER w2 OR coalesce(beside AND lag(page) OVER w2 = page AND lag(col) OVER w2 = col AND NOT lag(beside) OVER w2, false) THEN ' ' || text ELSE text END AS piece
 FROM (SELECT *, wrap > 0 AND ord % 3 = 0 AS beside FROM text_lines) t JOIN ({RELIABLE}) r ON r.doc_id = t.doc_id WINDOW w1 AS (PARTITION BY t.doc_id, line_no), w2 AS (PARTITION BY t.doc_id, line_no ORDER BY ord)) GROUP BY doc_id, line_no""", ("text_lines",))
def _(spark, folder):
    # every third row is a piece on the row before it
    lines = text_lines(spark, folder).withColumn("emphasis_ends", F.lit(False))
    beside = (F.col("wrap") > 0) & (F.col("ord") % 3 == 0)
    moved = lines.withColumns({"y0": F.col("y0") - F.when(beside, 13).otherwise(0), "x0": F.when(beside, F.lit(300.0) + F.col("col") * 270).otherwise(F.col("x0")),
                               "x1": F.when(beside, F.lit(310.0) + F.col("col") * 270).otherwise(F.col("x1"))})
    return ops.para_text(moved, ops.space_reliable(lines), ["doc_id", "line_no"])


@query("boxes_paired", "D26 D8", """
WITH RECURSIVE f AS (SELECT doc_id, ord, CASE WHEN l_discount > 0.09 THEN 'line' ELSE 'box' END AS kind, l_suppkey % 9 = 0 AS parts, l_partkey % 8 <> 0 AS wide, ord * 100.0 AS x0, ord * 100.0 + 98 + l_suppkey % 4 AS x1, CASE WHEN l_quantity > 40 THEN 30.0 ELSE 0.0 END AS y0,
           CASE WHEN l_quantity > 40 THEN 30.0 ELSE 0.0 END + 50 + l_quantity AS y1 FROM numbers),
m AS (SELECT a.*, b.ord AS b_ord, b.x0 AS b_x0, b.x1 AS b_x1, b.y0 AS b_y0, b.y1 AS b_y1, coalesce(a.kind = 'box' AND b.kind = 'box' AND NOT a.parts AND NOT b.parts AND a.wide AND abs(a.x1 - b.x0) < 3
        AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.6 * least(a.y1 - a.y0, b.y1 - b.y0), false) AS meets FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id AND b.ord = a.ord + 1),
walk AS (SELECT doc_id, ord, meets AS taken FROM m WHERE ord = 1
 UNION ALL SELECT n.doc_id, n.ord, n.meets AND NOT w.taken FROM walk w JOIN m n ON n.doc_id = w.doc_id AND n.ord = w.ord + 1)
SELECT m.doc_id, m.ord, b_ord AS right_ord, x0, x1 AS middle, b_x0 AS right_x0, b_x1 AS x1, least(y0, b_y0) AS y0, greatest(y1, b_y1) AS y1 FROM m JOIN walk w ON w.doc_id = m.doc_id AND w.ord = m.ord WHERE taken""", ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder)
    x0, y0 = F.col("ord") * 100.0, F.when(F.col("l_quantity") > 40, 30.0).otherwise(0.0)
    flow = n.select("doc_id", "ord", F.col("number").alias("chunk"), F.when(F.col("l_discount") > 0.09, "line").otherwise("box").alias("kind"), (F.col("l_suppkey") % 9 == 0).alias("parts"),
                    (F.col("l_partkey") % 8 != 0).alias("wide"), x0.alias("x0"), y0.alias("y0"), (x0 + 98 + F.col("l_suppkey") % 4).alias("x1"), (y0 + 50 + F.col("l_quantity")).alias("y1"))
    return ops.paired_boxes(flow)
