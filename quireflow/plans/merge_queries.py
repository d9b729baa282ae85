"""Merging, renumbering and page planning over whole tables."""

from pyspark.sql import functions as F

from quireflow.operators import merge as ops
from quireflow.plans.registry import query, sql_view
from quireflow.plans.structure_queries import chunked
from quireflow.sources import corpus
from quireflow.sources.corpus import table


def bundle_items(spark, folder):
    """Conversations as files, ten to a bundle; questions keep the passage opened before them."""
    from quireflow.operators.structure import segment
    t = segment(corpus.turns(spark, folder))
    return t.select(F.floor(F.col("doc_id") / 10).alias("bundle"), F.col("doc_id").alias("file_ord"), "ord", "kind",
                    F.when(F.col("kind") != "guide", F.col("number") + F.col("doc_id") % 3 * 5).cast("int").alias("number"),
                    F.when(F.col("kind") != "answer", F.col("passage_id")).cast("int").alias("passage_id"), "text")


sql_view("bundle_items", """
SELECT doc_id // 10 AS bundle, doc_id AS file_ord, ord, kind, CASE WHEN kind <> 'guide' THEN CAST(number + doc_id % 3 * 5 AS INTEGER) END AS number,
       CASE WHEN kind <> 'answer' THEN CAST(sum(CASE WHEN kind = 'guide' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) END AS passage_id, text
FROM turns""", ("turns",))
sql_view("bundle_shifts", """
SELECT bundle, file_ord, CAST(coalesce(sum(span) OVER w, 0) - (coalesce(low, 1) - 1) AS INTEGER) AS shift, CAST(coalesce(sum(mp) OVER w, 0) AS INTEGER) AS pshift
FROM (SELECT *, coalesce(high - low + 1, 0) AS span FROM (
  SELECT bundle, file_ord, coalesce(min(number) FILTER (kind = 'question'), min(number) FILTER (kind = 'answer')) AS low, max(number) AS high, coalesce(max(passage_id), 0) AS mp
  FROM bundle_items GROUP BY bundle, file_ord))
WINDOW w AS (PARTITION BY bundle ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("bundle_items",))


@query("documents_merged", "E1", """
SELECT i.bundle, i.file_ord, i.ord, coalesce(number + shift, 0) AS new_number, coalesce(passage_id + pshift, -1) AS new_passage
FROM bundle_items i JOIN bundle_shifts s ON s.bundle = i.bundle AND s.file_ord = i.file_ord""", ("bundle_shifts",))
def _(spark, folder):
    out = ops.merge_docs(bundle_items(spark, folder))
    return out.select("bundle", "file_ord", "ord", F.coalesce("new_number", F.lit(0)).alias("new_number"), F.coalesce("new_passage", F.lit(-1)).alias("new_passage"))


@query("numbers_rewritten", "E2", """
SELECT i.file_ord, i.ord, CASE kind WHEN 'question' THEN (num + shift) || regexp_replace(text, '^\\d+', '') WHEN 'answer' THEN (num + shift) || regexp_replace(text, '^\\d+', '')
       ELSE '[' || (num + shift) || '~' || (num + 2 + shift) || '] x [ ' || (num + 7 + shift) || ' - ' || (num + 8 + shift) || ' ]' || text END AS text
FROM (SELECT *, CASE WHEN kind = 'guide' THEN ord + 1 ELSE TRY_CAST(regexp_extract(text, '^(\\d+)', 1) AS INTEGER) END AS num FROM bundle_items) i
JOIN bundle_shifts s ON s.bundle = i.bundle AND s.file_ord = i.file_ord""".replace("\\\\", "\\"), ("bundle_shifts",))
def _(spark, folder):
    items = bundle_items(spark, folder)
    n = F.col("ord") + 1
    guide = F.concat(F.lit("["), n.cast("string"), F.lit("~"), (n + 2).cast("string"), F.lit("] x [ "), (n + 7).cast("string"), F.lit(" - "),
                     (n + 8).cast("string"), F.lit(" ]"), "text")
    texts = ops.merge_docs(items.withColumn("text", F.when(F.col("kind") == "guide", guide).otherwise(F.col("text"))))
    return ops.rewrite_numbers(texts).select("file_ord", "ord", "text")


@query("run_spans_replaced", "E2", """
SELECT doc_id, row_no, substr(text, 1, 3) || '<N>' || substr(text, 10) AS text FROM layout_rows WHERE length(text) >= 12""", ("layout_rows",))
def _(spark, folder):
    rows = corpus.layout_rows(spark, folder).where(F.length("text") >= 12)

    def run(start, n, underline):
        return F.struct(F.substring("text", start + 1, n).alias("text"), F.lit(start).alias("at"), F.lit(underline).alias("underline"))

    runs = F.array(run(0, 5, False), run(5, 2, True), run(7, 10000, False))
    out = ops.replace_in_runs(runs, F.lit(3), F.lit(9), F.lit("<N>"))
    return rows.select("doc_id", "row_no", F.array_join(F.transform(out, lambda r: r["text"]), "").alias("text"))


@query("merged_stats", "E3", """
SELECT bundle, CAST(count(*) FILTER (kind = 'question') AS DOUBLE) AS questions, CAST(count(*) FILTER (kind = 'answer') AS DOUBLE) AS answers,
       CAST(count(DISTINCT file_ord) AS DOUBLE) AS merged_files FROM bundle_items GROUP BY bundle""", ("bundle_items",))
def _(spark, folder):
    docs = bundle_items(spark, folder).groupBy("bundle", "file_ord").agg(F.create_map(
        F.lit("questions"), F.count_if(F.col("kind") == "question").cast("double"), F.lit("answers"), F.count_if(F.col("kind") == "answer").cast("double")).alias("stats"))
    return ops.merge_stats(docs).select("bundle", *[F.col("stats")[k].alias(k) for k in ("questions", "answers", "merged_files")])


@query("merged_warnings", "E3", """
SELECT bundle, file_ord, 0 AS no, 'f' || file_ord || ': n' || count(*) AS warning FROM bundle_items GROUP BY bundle, file_ord
UNION ALL SELECT bundle, file_ord, 1, 'f' || file_ord || ': 문제를 찾지 못해 내용만 옮겼습니다(자동 번호·정답 미주 없음)' FROM bundle_items GROUP BY bundle, file_ord HAVING count(*) FILTER (kind = 'question' AND number > 6) = 0""", ("bundle_items",))
def _(spark, folder):
    docs = bundle_items(spark, folder).groupBy("bundle", "file_ord").agg(
        F.array(F.concat(F.lit("n"), F.count("*").cast("string"))).alias("warnings"), F.count_if((F.col("kind") == "question") & (F.col("number") > 6)).alias("questions"))
    return ops.merge_warnings(docs.withColumn("name", F.concat(F.lit("f"), F.col("file_ord").cast("string"))))


def questions_answers(spark, folder):
    n = chunked(corpus.numbers(spark, folder))
    q = n.where("l_returnflag <> 'R'").select("doc_id", "ord", "chunk", "number")
    a = n.where("l_linestatus = 'O'").select("doc_id", "ord", F.when(F.col("l_quantity") > 45, F.col("number") + 3).otherwise(F.col("number")).alias("number"))
    return q, a


NOTES = """
q AS (SELECT doc_id, ord, number FROM numbers WHERE l_returnflag <> 'R'),
a AS (SELECT doc_id, ord, CASE WHEN l_quantity > 45 THEN number + 3 ELSE number END AS number FROM numbers WHERE l_linestatus = 'O'),
f AS (SELECT doc_id, number, min(ord) AS answer_ord FROM a GROUP BY ALL),
b AS (SELECT q.*, answer_ord, count(answer_ord) OVER (PARTITION BY q.doc_id) AS hits FROM q LEFT JOIN f ON f.doc_id = q.doc_id AND f.number = q.number)"""


@query("notes_automatic", "E4", f"""
WITH {NOTES} SELECT doc_id, ord, CAST(first_value(number) OVER w + row_number() OVER w - 1 AS INTEGER) AS note, answer_ord IS NULL AS placeholder, false AS restart
FROM b WHERE hits > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""", ("numbers",))
def _(spark, folder):
    return ops.plan_notes(*questions_answers(spark, folder))


@query("notes_literal", "E4", f"""
WITH {NOTES} SELECT doc_id, ord, number AS note, false AS placeholder, coalesce(number <> lag(number) OVER (PARTITION BY doc_id ORDER BY ord) + 1, false) AS restart
FROM b WHERE answer_ord IS NOT NULL""", ("numbers",))
def _(spark, folder):
    return ops.plan_notes(*questions_answers(spark, folder), auto=False)


@query("answers_left_over", "E4", f"""
WITH {NOTES} SELECT a.doc_id, a.ord, a.number FROM a JOIN f ON f.doc_id = a.doc_id AND f.number = a.number
WHERE a.ord <> f.answer_ord OR NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = a.doc_id AND q.number = a.number)""", ("numbers",))
def _(spark, folder):
    return ops.leftover_answers(*questions_answers(spark, folder)).select("doc_id", "ord", "number")


@query("number_gaps", "E5", """
SELECT doc_id, ord, number || '→' || nx AS gap FROM (SELECT *, lead(number) OVER (PARTITION BY doc_id ORDER BY ord) AS nx FROM numbers) WHERE nx <> number + 1""", ("numbers",))
def _(spark, folder):
    return ops.number_gaps(chunked(corpus.numbers(spark, folder)))


@query("page_scales", "E6", """
SELECT doc_id, CAST(g AS BIGINT) AS "group", CASE WHEN max(y1) - min(y0) > room THEN room / (max(y1) - min(y0)) ELSE 1.0 END AS scale
FROM (SELECT doc_id, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS g, CASE WHEN l_linestatus = 'O' THEN l_partkey % 900 * 1.0::DOUBLE END AS y0,
             CASE WHEN l_linestatus = 'O' THEN l_partkey % 900 + l_quantity * 10 END AS y1, 0.92::DOUBLE * 77382 / 110 AS room FROM numbers) GROUP BY doc_id, g, room""", ("numbers",))
def _(spark, folder):
    n = chunked(corpus.numbers(spark, folder))
    placed = F.col("l_linestatus") == "O"
    y = F.col("l_partkey") % 900 * 1.0
    items = n.select("doc_id", "chunk", "ord", (F.col("l_returnflag") == "A").alias("top"), F.when(placed, y).alias("y0"), F.when(placed, y + F.col("l_quantity") * 10).alias("y1"))
    return ops.page_scales(items)


@query("breaks_planned", "E7", """
WITH r AS (SELECT *, CASE WHEN switch THEN top AND pw IS NOT NULL ELSE top AND pw IS NOT NULL AND (wide OR faithful) END AS page_break FROM (
  SELECT *, pw IS NOT NULL AND wide <> pw AS switch FROM (
   SELECT *, lag(wide) OVER w AS pw, lead(wide) OVER w AS nw, lead(kind) OVER w AS nk FROM (
    SELECT doc_id, ord, CASE WHEN l_quantity < 20 THEN 'blank' WHEN l_quantity < 35 THEN 'text' ELSE 'box' END AS kind, l_returnflag = 'A' AS wide, l_linestatus = 'O' AS top,
           l_discount > 0.06 AS cb, doc_id % 2 = 0 AS faithful FROM numbers) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)))),
z AS (SELECT *, first_value(CASE WHEN NOT (kind = 'blank' AND NOT page_break) THEN page_break END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM r)
SELECT doc_id, ord, switch, page_break, NOT switch AND NOT page_break AND cb AND NOT wide AS column_break,
       wide AND kind = 'text' AND coalesce(nw, false) AND coalesce(nk IN ('box', 'table', 'image'), false) AS keep_next,
       kind = 'blank' AND NOT page_break AND coalesce(nxt, false) AS dropped FROM z""", ("numbers",))
def _(spark, folder):
    n = chunked(corpus.numbers(spark, folder))
    items = n.select("doc_id", "chunk", "ord", F.when(F.col("l_quantity") < 20, "blank").when(F.col("l_quantity") < 35, "text").otherwise("box").alias("kind"),
                     F.lit("개관 정리").alias("text"), (F.col("l_returnflag") == "A").alias("wide"), (F.col("l_linestatus") == "O").alias("top"),
                     (F.col("l_discount") > 0.06).alias("col_break"), (F.col("doc_id") % 2 == 0).alias("faithful"))
    return ops.plan_breaks(items)


@query("kept_with_figure", "E8", """
SELECT doc_id, passage, ord FROM (SELECT *, sum(CASE WHEN kind = 'text' THEN n ELSE 0 END) OVER (PARTITION BY doc_id, passage) AS chars FROM (
 SELECT * FROM (SELECT doc_id, l_linestatus AS passage, ord, CASE WHEN l_returnflag = 'A' THEN 'image' ELSE 'text' END AS kind, CAST(l_quantity AS INTEGER) * 5 AS n,
        min(CASE WHEN l_returnflag = 'A' THEN ord END) OVER (PARTITION BY doc_id, l_linestatus) AS fb FROM numbers) WHERE ord < fb)) WHERE chars <= 300""", ("numbers",))
def _(spark, folder):
    paras = corpus.numbers(spark, folder).select("doc_id", F.col("l_linestatus").alias("passage"), "ord", F.when(F.col("l_returnflag") == "A", "image").otherwise("text").alias("kind"),
                                                 F.expr("repeat('abcde', int(l_quantity))").alias("text"))
    return ops.keep_with_figure(paras)


@query("grid_widths", "E9", """
WITH g AS (SELECT *, greatest(width, need) AS w, greatest(width, need) - need AS slack FROM (SELECT doc_id, ord, CAST(l_quantity * 200 AS BIGINT) AS width, l_partkey % 6000 AS need FROM numbers)),
s AS (SELECT *, greatest(sum(w) OVER p - 24000, 0) AS over, sum(slack) OVER p AS ts FROM g WINDOW p AS (PARTITION BY doc_id)),
t AS (SELECT *, w - CASE WHEN ts >= over THEN floor(over * slack / greatest(ts, 1)) ELSE slack END AS w2 FROM s)
SELECT doc_id, ord, CAST(CASE WHEN over > 0 AND sum(w2) OVER (PARTITION BY doc_id) > 24000 THEN floor(w2 * 24000 / sum(w2) OVER (PARTITION BY doc_id)) ELSE w2 END AS BIGINT) AS fitted FROM t""", ("numbers",))
def _(spark, folder):
    cols = corpus.numbers(spark, folder).select("doc_id", "ord", (F.col("l_quantity") * 200).cast("long").alias("width"), (F.col("l_partkey") % 6000).alias("need"))
    return ops.fit_grid(cols, ["doc_id"], 24000).select("doc_id", "ord", "fitted")


@query("table_widths", "E10", """
WITH t AS (SELECT o_orderkey AS id, 30.0::DOUBLE + o_custkey % 150 AS a, 30.0::DOUBLE + o_custkey % 150 + 40 + o_orderkey % 120 AS b, 20.0::DOUBLE + o_custkey % 30 AS c,
                  CASE WHEN o_orderkey % 2 = 0 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS tp FROM orders),
k AS (SELECT *, CASE WHEN tp > 0 THEN 1000.0 / tp ELSE 110.0 END AS ky FROM t),
f AS (SELECT *, least(ky, 26000.0 / greatest(1.0, b)) AS kx, round_even(a * ky, 0) AS fa, round_even(b * ky, 0) AS fb FROM k)
SELECT id, CASE WHEN tp > 0 AND kx < ky AND 26000 - fa >= 0.4 * (fb - fa) THEN '0,' || CAST(fa AS INTEGER) || ',26000' ELSE '0,' || CAST(round_even(a * kx, 0) AS INTEGER) || ',' || CAST(round_even(b * kx, 0) AS INTEGER) END AS xs,
       '0,' || CAST(round_even(c * ky, 0) AS INTEGER) AS ys FROM f""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    a = F.lit(30.0) + F.col("o_custkey") % 150
    tables = o.select(F.col("o_orderkey").alias("id"), F.array(F.lit(50.0), a + 50, a + 90 + F.col("o_orderkey") % 120).alias("xs"),
                      F.array(F.lit(10.0), F.lit(30.0) + F.col("o_custkey") % 30).alias("ys"), F.when(F.col("o_orderkey") % 2 == 0, 8.0).otherwise(0.0).alias("text_pt"))
    out = ops.fit_table(tables, 26000)
    return out.select("id", F.array_join(F.transform("out_xs", lambda v: v.cast("string")), ",").alias("xs"), F.array_join(F.transform("out_ys", lambda v: v.cast("string")), ",").alias("ys"))


@query("rows_emitted", "E11", """
SELECT doc_id, ord, CAST(r AS INTEGER) AS "row", CASE WHEN r = 0 THEN kind WHEN kind = 'box' THEN 'spacer' ELSE 'blank' END AS row_kind
FROM (SELECT *, unnest(range(CASE WHEN kind = 'question' AND l_linestatus = 'O' AND number = 1 THEN 3 WHEN kind = 'box' THEN 2 ELSE 1 END)) AS r
      FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'question' WHEN 'N' THEN 'box' ELSE 'text' END AS kind FROM numbers))""", ("numbers",))
def _(spark, folder):
    items = corpus.numbers(spark, folder).select("doc_id", "ord", F.when(F.col("l_returnflag") == "A", "question").when(F.col("l_returnflag") == "N", "box").otherwise("text").alias("kind"),
                                                 F.when(F.col("l_linestatus") == "O", "subjective").otherwise("objective").alias("qtype"), (F.col("number") - 1).alias("choices"))
    return ops.emit_rows(items).select("doc_id", "ord", "row", "row_kind")


@query("prefixes_stripped", "E12", """
SELECT doc_id, ord, regexp_replace(text, '^\\s*\\d{1,3}\\s*[).]\\s*', '') AS text FROM turns""".replace("\\\\", "\\"), ("turns",))
def _(spark, folder):
    t = corpus.turns(spark, folder)
    text = F.when(F.col("kind") == "answer", ops.strip_prefix(F.col("text"), ops.ANSWER_PREFIX)).otherwise(ops.strip_prefix(F.col("text"), ops.STEM_PREFIX))
    return t.select("doc_id", "ord", text.alias("text"))


@query("run_prefixes_stripped", "E12", """
SELECT doc_id, row_no, substr(text, 7) AS text, CASE WHEN length(text) > 9 THEN 2 WHEN length(text) > 6 THEN 1 ELSE 0 END AS runs FROM layout_rows""", ("layout_rows",))
def _(spark, folder):
    def run(start, n):
        return F.struct(F.substring("text", start + 1, n).alias("text"), F.lit(start).alias("at"), F.lit(False).alias("underline"))
    out = ops.strip_prefix_runs(F.array(run(0, 4), run(4, 5), run(9, 10000)), F.lit(6))
    return corpus.layout_rows(spark, folder).select("doc_id", "row_no", F.array_join(F.transform(out, lambda r: r["text"]), "").alias("text"), F.size(out).alias("runs"))


@query("spacing_planned", "E13", """
SELECT doc_id, ord, CASE WHEN scale < 1.0 AND kind = 'text' THEN greatest(100, CAST(round_even(CASE WHEN pct > 0 THEN pct ELSE 155 END * scale, 0) AS INTEGER)) ELSE pct END AS line,
       CASE WHEN gap > 0 THEN CAST(floor(gap * 10.0 * 100 * scale) AS INTEGER) ELSE 0 END AS space_above
FROM (SELECT doc_id, ord, CAST(l_quantity * 4 AS INTEGER) * (number % 2) AS pct, l_discount * 10 AS gap, 1.25::DOUBLE - l_quantity / 100 AS scale, CASE WHEN l_returnflag = 'A' THEN 'image' ELSE 'text' END AS kind FROM numbers)""", ("numbers",))
def _(spark, folder):
    paras = corpus.numbers(spark, folder).select("doc_id", "ord", ((F.col("l_quantity") * 4).cast("int") * (F.col("number") % 2)).alias("line_pct"), (F.col("l_discount") * 10).alias("gap"),
                                                 (F.lit(1.25) - F.col("l_quantity") / 100).alias("scale"), F.when(F.col("l_returnflag") == "A", "image").otherwise("text").alias("kind"))
    return ops.spacing_plan(paras).select("doc_id", "ord", "line", "space_above")


@query("widths_planned", "E14", """
SELECT doc_id, ord, w AS width, w - 3000 AS in_box, w - 600 AS free FROM (SELECT doc_id, ord, CASE WHEN l_returnflag = 'A' THEN 54992 ELSE 26362 END AS w FROM numbers)""", ("numbers",))
def _(spark, folder):
    items = corpus.numbers(spark, folder).select("doc_id", "ord", (F.col("l_returnflag") == "A").alias("wide"))
    return ops.width_plan(items).select("doc_id", "ord", "width", "in_box", "free")
