"""Checks of outputs against sources, and integrity checks, over whole tables."""

from pyspark.sql import functions as F

from quireflow.functions import text as tx
from quireflow.operators import quality as ops
from quireflow.plans.registry import query, sql_view
from quireflow.session import settle
from quireflow.sources import corpus
from quireflow.sources.corpus import table

REPEATS = 5  # a line written this often in the corpus counts as repeated


def source_and_output(spark, folder):
    """Source lines of each document, and the document as rebuilt without lines repeated across the corpus."""
    lines = corpus.doc_lines(spark, folder).withColumn("key", tx.norm_repeat("text"))
    # written first: a few repeated lines are then sent to where the texts are
    repeated = settle(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS).select("key"))
    kept = lines.join(repeated, "key", "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), " ")
    output = kept.groupBy("doc_id").agg(joined.alias("text"))
    source = lines.select(F.col("doc_id").alias("pair"), "line_no", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), "text")
    # the checks read both sides more than once
    return settle(source), settle(output.select(F.col("doc_id").alias("pair"), "text"))


sql_view("cover_source", """
SELECT doc_id AS pair, line_no, CAST(line_no // 40 + 1 AS INTEGER) AS page, text,
       regexp_replace(text, '\\s+', '', 'g') AS c,
       regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '\\d+', '#', 'g') AS key FROM doc_lines""".replace("\\\\", "\\"), ("doc_lines",))
sql_view("cover_output", """
SELECT pair, regexp_replace(string_agg(text, ' ' ORDER BY line_no), '\\s+', '', 'g') AS c FROM cover_source
WHERE key NOT IN (SELECT key FROM cover_source GROUP BY key HAVING count(*) >= 5) GROUP BY pair""".replace("\\\\", "\\"), ("cover_source",))


def pieces(text):
    """All overlapping six-character pieces: six passes of disjoint ones, so the cost is linear in the text."""
    return " || ".join(f"regexp_extract_all(substr({text}, {k}), '(?s).{{6}}')" for k in range(1, 7))


sql_view("line_shingles", f"""
SELECT DISTINCT pair, line_no, unnest({pieces('c')}) AS sh FROM cover_source""", ("cover_source",))
sql_view("out_shingles", f"""
SELECT DISTINCT pair, unnest({pieces('c')}) AS sh FROM cover_output""", ("cover_output",))
sql_view("cover_scores", """
SELECT p.pair, round_even(coalesce(both_n, 0) / greatest(1, coalesce(src, 0)) * 10000, 0) / 10000 AS coverage,
       round_even(coalesce(both_n, 0) / greatest(1, coalesce(out_n, 0)) * 10000, 0) / 10000 AS "precision"
FROM (SELECT DISTINCT pair FROM cover_source) p
LEFT JOIN (SELECT s.pair, count(*) AS src, count(o.sh) AS both_n FROM (SELECT DISTINCT pair, sh FROM line_shingles) s
           LEFT JOIN out_shingles o ON s.pair = o.pair AND s.sh = o.sh GROUP BY s.pair) a ON a.pair = p.pair
LEFT JOIN (SELECT pair, count(*) AS out_n FROM out_shingles GROUP BY pair) b ON b.pair = p.pair""", ("line_shingles", "out_shingles"))
sql_view("cover_missing", """
SELECT s.pair, s.line_no, 'p' || s.page || ': ' || substr(s.text, 1, 40) AS line
FROM cover_source s JOIN (SELECT l.pair, l.line_no FROM line_shingles l LEFT JOIN out_shingles o ON l.pair = o.pair AND l.sh = o.sh
                          GROUP BY l.pair, l.line_no HAVING count(o.sh) * 2 < count(*)) m
ON s.pair = m.pair AND s.line_no = m.line_no""", ("line_shingles", "out_shingles"))


@query("text_coverage", "F-1", "SELECT * FROM cover_scores", ("cover_scores",))
def _(spark, folder):
    return ops.coverage(*source_and_output(spark, folder))


@query("text_coverage_masked", "F-1 B9", f"""
SELECT p.pair, coalesce(round_even(hits / n * 10000, 0) / 10000, 0) AS coverage FROM (SELECT DISTINCT pair FROM cover_source) p
LEFT JOIN (SELECT s.pair, count(o.sh) AS hits, count(*) AS n
  FROM (SELECT DISTINCT pair, unnest({pieces('c')}) AS sh FROM (SELECT pair, regexp_replace(c, '[0-9]+', '#', 'g') AS c FROM cover_source)) s
  LEFT JOIN (SELECT DISTINCT pair, unnest({pieces('c')}) AS sh FROM (SELECT pair, regexp_replace(c, '[0-9]+', '#', 'g') AS c FROM cover_output)) o
  ON s.pair = o.pair AND s.sh = o.sh GROUP BY s.pair) x ON x.pair = p.pair""", ("cover_output",))
def _(spark, folder):
    scores = ops.coverage(*source_and_output(spark, folder), numbers=False)
    return scores.select("pair", "coverage")


@query("missing_source_lines", "F-2", """
SELECT pair, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY line_no) AS no FROM cover_missing)
WHERE no <= 30""", ("cover_missing",))
def _(spark, folder):
    return ops.first_missing(ops.missing_lines(*source_and_output(spark, folder))).drop("no")


@query("coverage_status", "F-3", """
SELECT pair, coverage, coalesce(n, 0) AS missing, CASE WHEN coverage < 0.97 THEN 'FAIL'
       WHEN coverage < 0.995 OR coalesce(n, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM cover_scores LEFT JOIN (SELECT pair, count(*) AS n FROM cover_missing GROUP BY pair) USING (pair)""", ("cover_scores", "cover_missing"))
def _(spark, folder):
    source, output = source_and_output(spark, folder)
    out = ops.coverage_status(ops.coverage(source, output), ops.missing_lines(source, output))
    return out.select("pair", "coverage", "missing", "status")


@query("benchmark_passages", "F-1 F-3", f"""
WITH items AS (SELECT DISTINCT item_id AS item, unnest({pieces('c')}) AS sh FROM (
       SELECT item_id, regexp_replace(line, '\\s+', '', 'g') AS c
       FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark))),
docs AS (SELECT DISTINCT doc_id AS pair, unnest({pieces('c')}) AS sh FROM (
       SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS c FROM documents))
SELECT item, pair, hits, round_even(hits / n * 10000, 0) / 10000 AS coverage
FROM (SELECT item, pair, count(*) AS hits FROM items JOIN docs USING (sh) GROUP BY item, pair)
JOIN (SELECT item, count(*) AS n FROM items GROUP BY item) USING (item) WHERE hits >= n * 0.5""")
def _(spark, folder):
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("item"), F.explode(F.split("text", "\n")).alias("text"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pair"), "text")
    return ops.passage_coverage(items, docs)


def numbered(spark, folder):
    return corpus.numbers(spark, folder).select("doc_id", "ord", F.col("number").alias("chunk"), "number")


def shown(items):
    """The questions as an output shows them, a paragraph each."""
    return items.withColumn("text", F.concat(F.col("number").cast("string"), F.lit(". text"))).drop("number")


CHAIN = """
WITH RECURSIVE chain AS (
  SELECT doc_id, 0 AS pos, min(number) - 1 AS number FROM numbers GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, n.ord, n.number FROM chain c JOIN numbers n ON n.doc_id = c.doc_id AND n.number = c.number + 1
  WHERE n.ord > c.pos AND NOT EXISTS (SELECT 1 FROM numbers m WHERE m.doc_id = n.doc_id AND m.number = n.number
                                      AND m.ord > c.pos AND m.ord < n.ord))"""


@query("question_order", "F-4", CHAIN + """
SELECT doc_id, questions, seq_ok, found, CASE WHEN seq_ok AND found = questions THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT doc_id, count(*) AS questions, bool_and(prev IS NULL OR number = prev + 1) AS seq_ok
      FROM (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM numbers) GROUP BY doc_id)
JOIN (SELECT doc_id, count(*) - 1 AS found FROM chain GROUP BY doc_id) USING (doc_id)""", ("numbers",))
def _(spark, folder):
    items = numbered(spark, folder)
    return ops.order_status(items, shown(items))


sql_view("order_questions", "SELECT * FROM numbers WHERE doc_id % 7 <> 0", ("numbers",))
sql_view("order_shown", """
SELECT doc_id, CASE WHEN doc_id % 5 = 1 AND ord <= 2 THEN 3 - ord ELSE ord END AS pos, number
FROM numbers WHERE NOT (doc_id % 5 = 0 AND ord = 2)""", ("numbers",))


@query("question_order_of_outputs", "F-4", """
WITH RECURSIVE chain AS (
  SELECT doc_id, 0 AS pos, arg_min(number, ord) - 1 AS number, count(*) AS questions, arg_min(number, ord) AS start FROM order_questions GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, n.pos, n.number, c.questions, c.start FROM chain c JOIN order_shown n ON n.doc_id = c.doc_id AND n.number = c.number + 1
  WHERE n.pos > c.pos AND n.number < c.start + c.questions
    AND NOT EXISTS (SELECT 1 FROM order_shown m WHERE m.doc_id = n.doc_id AND m.number = n.number AND m.pos > c.pos AND m.pos < n.pos))
SELECT doc_id, coalesce(questions, 0) AS questions, coalesce(seq_ok, true) AS seq_ok, coalesce(found, 0) AS found,
       CASE WHEN questions IS NULL AND doc_id % 2 = 0 THEN 'WARN' WHEN seq_ok AND found = questions THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT DISTINCT doc_id FROM numbers)
LEFT JOIN (SELECT doc_id, count(*) AS questions, bool_and(prev IS NULL OR number = prev + 1) AS seq_ok
           FROM (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM order_questions) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) - 1 AS found FROM chain GROUP BY doc_id) USING (doc_id)""", ("order_questions", "order_shown"))
def _(spark, folder):
    items = numbered(spark, folder)
    swapped = (F.col("doc_id") % 5 == 1) & (F.col("ord") <= 2)
    at = F.when(swapped, 3 - F.col("ord")).otherwise(F.col("ord")).cast("int")
    output = shown(items).where(~((F.col("doc_id") % 5 == 0) & (F.col("ord") == 2))).withColumn("ord", at).withColumn("chunk", F.lit(0))
    return ops.order_status(items.where("doc_id % 7 <> 0"), output, items.where("doc_id % 2 <> 0").select("doc_id"))


@query("choice_counts", "F-5", """
SELECT doc_id, count(*) AS choices FROM numbers GROUP BY doc_id HAVING count(*) <> 5 AND NOT bool_and(l_returnflag = 'R')""", ("numbers",))
def _(spark, folder):
    return ops.choice_counts(corpus.numbers(spark, folder).withColumn("written", F.col("l_returnflag") == "R"), ["doc_id"])


@query("counts_reconciled", "F-6", """
SELECT *, answers > 0 AND answers <> questions AS answers_differ, source_heads > 0 AND answers < source_heads AS heads_lost,
       planned > 0 AND planned <> answers AS notes_differ
FROM (SELECT doc_id, count(*) FILTER (kind = 'question') AS questions, count(*) FILTER (kind = 'answer') AS answers,
             count(*) FILTER (regexp_matches(text, '^\\s*[0-9]{1,3}\\s*\\)\\s*\\[?\\s*정답')) AS source_heads,
             count(*) FILTER (kind = 'answer' AND number <= 2) AS planned FROM turns GROUP BY doc_id)""".replace("\\\\", "\\"), ("turns",))
def _(spark, folder):
    flow = corpus.turns(spark, folder)
    notes = flow.where("kind = 'answer' and number <= 2").groupBy("doc_id").agg(F.count("*").alias("planned"))
    return ops.reconcile_counts(flow, notes)


@query("doubled_note_numbers", "F-7", """
SELECT doc_id, ord FROM turns WHERE kind = 'answer' AND number % 2 = 1""", ("turns",))
def _(spark, folder):
    answers = corpus.turns(spark, folder).where("kind = 'answer'")
    shown = F.when(F.col("number") % 2 == 1, F.concat(F.col("number").cast("string"), F.lit(") "), "text")).otherwise(
        F.concat(F.col("number").cast("string"), F.lit(") "), F.regexp_replace("text", r"^\d+\) ", "")))
    return ops.doubled_numbers(answers.withColumn("text", shown)).select("doc_id", "ord")


def conv_paras(spark, folder):
    return corpus.turns(spark, folder).select(
        "doc_id", "chunk", "ord", F.when(F.col("number") % 3 == 0, " ").otherwise(F.col("text")).alias("text"),
        (F.col("kind") == "answer").alias("boxed"), F.when(F.col("number") % 6 == 0, 1).otherwise(0).alias("pics"))


sql_view("conv_paras", """
SELECT doc_id, ord, CASE WHEN number % 3 = 0 THEN ' ' ELSE text END AS text, kind = 'answer' AS boxed,
       CASE WHEN number % 6 = 0 THEN 1 ELSE 0 END AS pics FROM turns""", ("turns",))
sql_view("conv_groups", """
SELECT doc_id, grp, min(ord) AS first, max(ord) AS last,
       NOT bool_or(opens AND regexp_matches(coalesce(pt, ''), '^\\s*(※|\\[\\s*\\d+\\s*[~∼～–-]\\s*\\d+\\s*\\])'))
       AND bool_or(closes AND coalesce(trim(nt) <> '' OR np > 0, false)) AS no_spacer
FROM (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS grp
      FROM (SELECT *, boxed AND NOT coalesce(lag(boxed) OVER w, false) AS opens, NOT coalesce(lead(boxed) OVER w, false) AS closes,
                   lag(text) OVER w AS pt, lead(text) OVER w AS nt, lead(pics) OVER w AS np
            FROM conv_paras WINDOW w AS (PARTITION BY doc_id ORDER BY ord))) WHERE boxed GROUP BY doc_id, grp""".replace("\\\\", "\\"), ("conv_paras",))


@query("bordered_groups", "F-8", "SELECT * FROM conv_groups", ("conv_groups",))
def _(spark, folder):
    return ops.box_groups(conv_paras(spark, folder))


@query("bordered_group_counts", "F-8", """
SELECT doc_id, coalesce(found, 0) AS found, expected, CASE WHEN coalesce(found, 0) = expected THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT doc_id, count(*) FILTER (kind = 'answer') AS expected FROM turns GROUP BY doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS found FROM conv_groups GROUP BY doc_id) USING (doc_id)""", ("conv_groups",))
def _(spark, folder):
    expected = corpus.turns(spark, folder).groupBy("doc_id").agg(F.count_if(F.col("kind") == "answer").alias("expected"))
    return ops.box_count_status(ops.box_groups(conv_paras(spark, folder)), expected)


@query("spacers_missing", "F-9", """
SELECT doc_id, count(*) FILTER (no_spacer) AS missing FROM conv_groups GROUP BY doc_id""", ("conv_groups",))
def _(spark, folder):
    return ops.spacer_missing(ops.box_groups(conv_paras(spark, folder)))


@query("dangling_parts", "F-10", """
SELECT l_partkey AS id, count(*) AS uses FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
GROUP BY 1""")
def _(spark, folder):
    refs = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    defs = table(spark, folder, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"))
    return ops.dangling(refs, defs, "id")


@query("orders_unreferenced", "F-10", """
SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(spark, folder):
    return ops.unreferenced(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")),
                            table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("declared_counts", "F-11", """
SELECT o_orderkey AS id, o_custkey % 8 AS declared, coalesce(n, 0) AS actual FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey % 8 <> coalesce(n, 0)""")
def _(spark, folder):
    declared = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).alias("declared"))
    return ops.count_mismatch(declared, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("grid_errors", "F-12", """
WITH t AS (SELECT o_orderkey AS table_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS rows, CAST(o_custkey % 4 + 1 AS INTEGER) AS cols FROM orders),
g AS (SELECT table_id, row, col + CASE WHEN table_id % 11 = 0 THEN 1 ELSE 0 END AS col, count(*) AS n FROM grid_cells GROUP BY ALL),
c AS (SELECT t.table_id, count(*) FILTER (n > 1) AS doubled, count(*) FILTER (g.col >= t.cols) AS outside, any_value(t.rows) * any_value(t.cols) - count(*) FILTER (g.col < t.cols) AS empty
      FROM t LEFT JOIN g ON g.table_id = t.table_id GROUP BY t.table_id)
SELECT * FROM c WHERE doubled > 0 OR outside > 0 OR empty > 0""", ("grid_cells",))
def _(spark, folder):
    # all tables against cells that miss one, double one or, in every eleventh table, stand one column too far right
    tables = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("rows"), (F.col("o_custkey") % 4 + 1).cast("int").alias("cols"))
    cells = corpus.grid_cells(spark, folder).withColumn("col", F.col("col") + F.when(F.col("table_id") % 11 == 0, 1).otherwise(0))
    return ops.grid_errors(tables, cells.drop("rows", "cols"))


@query("paragraph_numbers", "F-13", """
SELECT doc_id, ord, CAST(start + row_number() OVER (PARTITION BY doc_id, num_id ORDER BY ord) - 1 AS INTEGER) AS shown
FROM (SELECT doc_id, ord, l_returnflag AS num_id, CASE l_returnflag WHEN 'A' THEN 1 ELSE 13 END AS start FROM numbers)""", ("numbers",))
def _(spark, folder):
    paras = corpus.numbers(spark, folder).select(
        "doc_id", "ord", F.col("number").alias("chunk"), F.col("l_returnflag").alias("num_id"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(13).alias("start"))
    return ops.auto_numbers(paras).select("doc_id", "ord", "shown")


@query("bad_attribute_values", "F-14", """
SELECT p_partkey AS id FROM part WHERE NOT regexp_full_match(p_type || CASE WHEN p_size % 4 = 0 THEN ' x' ELSE '' END, '[A-Z_]+')""")
def _(spark, folder):
    value = F.concat("p_type", F.when(F.col("p_size") % 4 == 0, " x").otherwise(""))
    return ops.bad_values(table(spark, folder, "part").withColumn("v", value), "v").select(F.col("p_partkey").alias("id"))


@query("status_rollup", "F-15", """
SELECT doc_id, CASE max(severity) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status,
       coalesce(string_agg(message, '; ' ORDER BY check_no) FILTER (severity = 2), '') AS causes
FROM (SELECT doc_id, 1 AS check_no, CASE WHEN count(*) <> 5 THEN 1 ELSE 0 END AS severity, 'choices ' || count(*) AS message FROM numbers GROUP BY doc_id
      UNION ALL SELECT doc_id, 2, CASE WHEN min(number) <> 1 THEN 2 ELSE 0 END, 'starts at ' || min(number) FROM numbers GROUP BY doc_id
      UNION ALL SELECT doc_id, 3, CASE WHEN count(*) <> count(DISTINCT number) THEN 2 ELSE 0 END, 'repeats ' || (count(*) - count(DISTINCT number)) FROM numbers GROUP BY doc_id)
GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    facts = corpus.numbers(spark, folder).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("number").alias("low"), F.count_distinct("number").alias("d"))

    def check(no, bad, severity, message):
        return facts.select("doc_id", F.lit(no).alias("check_no"), F.when(bad, severity).otherwise(0).alias("severity"), message.alias("message"))

    return ops.rollup([
        check(1, F.col("n") != 5, 1, F.concat(F.lit("choices "), F.col("n").cast("string"))),
        check(2, F.col("low") != 1, 2, F.concat(F.lit("starts at "), F.col("low").cast("string"))),
        check(3, F.col("n") != F.col("d"), 2, F.concat(F.lit("repeats "), (F.col("n") - F.col("d")).cast("string")))])


@query("package_checks", "F-16", """
SELECT doc_id AS package, arg_min(CASE WHEN number = 1 THEN 'mimetype' ELSE 'content.xml' END, ord) = 'mimetype'
       AND arg_min(l_linestatus, ord) = 'O' AS first_ok, count(*) FILTER (l_discount > 0.08) AS broken FROM numbers GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    manifest = corpus.numbers(spark, folder).select(
        F.col("doc_id").alias("package"), "ord", F.when(F.col("number") == 1, "mimetype").otherwise("content.xml").alias("name"),
        (F.col("l_linestatus") == "O").alias("stored"), (F.col("l_discount") <= 0.08).alias("parses"))
    return ops.package_checks(manifest)


@query("runs_compared", "F-17", """
SELECT text, 'a' AS side, a - b AS times FROM (
 SELECT text, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b
 FROM (SELECT text, 'a' AS side FROM doc_lines WHERE lang <> 'fr' UNION ALL SELECT text, 'b' FROM doc_lines WHERE lang <> 'de')
 GROUP BY text) WHERE a > b
UNION ALL
SELECT text, 'b', b - a FROM (
 SELECT text, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b
 FROM (SELECT text, 'a' AS side FROM doc_lines WHERE lang <> 'fr' UNION ALL SELECT text, 'b' FROM doc_lines WHERE lang <> 'de')
 GROUP BY text) WHERE b > a""", ("doc_lines",))
def _(spark, folder):
    lines = corpus.doc_lines(spark, folder)
    return ops.diff_runs(lines.where("lang <> 'fr'").select("text"), lines.where("lang <> 'de'").select("text"))


@query("source_line_set", "F-18", """
SELECT doc_id, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM (
 SELECT doc_id, ord, 'n' || number AS text, CASE WHEN l_returnflag = 'A' THEN 1
   WHEN l_returnflag = 'N' THEN CASE WHEN EXISTS (SELECT 1 FROM numbers b WHERE b.doc_id = n.doc_id AND b.number = 1) THEN 1 ELSE 0 END
   WHEN l_linestatus = 'O' THEN CASE WHEN EXISTS (SELECT 1 FROM numbers b WHERE b.doc_id = n.doc_id AND b.number = 2) THEN 1 ELSE 0 END
   ELSE CASE WHEN EXISTS (SELECT 1 FROM numbers b WHERE b.doc_id = n.doc_id AND b.number = 2)
              AND EXISTS (SELECT 1 FROM numbers b WHERE b.doc_id = n.doc_id AND b.number = 3) THEN 1 ELSE 0 END END AS used
 FROM numbers n) WHERE used = 1 GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    # flag A: flow lines; N: lines of box 1; R/O: lines in cells of table 2; R/F: lines of table 3, nested in table 2
    n = corpus.numbers(spark, folder)
    text = F.concat(F.lit("n"), F.col("number").cast("string")).alias("text")
    nothing = F.lit(None).cast("int")

    def anchors(no, kind):
        return n.where(F.col("number") == no).select("doc_id", F.lit(kind).alias("kind"), F.lit(no).alias("ref"), F.lit("").alias("text")).distinct()

    flow = n.where("l_returnflag = 'A'").select("doc_id", F.lit("line").alias("kind"), nothing.alias("ref"), text).unionByName(
        anchors(1, "box")).unionByName(anchors(2, "table"))
    box = n.where("l_returnflag = 'N'").select("doc_id", F.lit(1).alias("box"), F.lit("line").alias("kind"), nothing.alias("ref"), text)
    cells = n.where("l_returnflag = 'R'").select(
        "doc_id", F.when(F.col("l_linestatus") == "O", 2).otherwise(3).alias("tbl"), F.lit("line").alias("kind"), nothing.alias("ref"), text)
    nested = n.where("number = 3").select("doc_id", F.lit(2).alias("tbl"), F.lit("table").alias("kind"), F.lit(3).alias("ref"), F.lit("").alias("text")).distinct()
    out = ops.source_lines(flow, box, cells.unionByName(nested))
    return out.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))
