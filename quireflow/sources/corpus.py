"""Tables of page primitives and structured documents derived from the given tables.

Each function reads whole tables and whole texts. The reference SQL of every view stands next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import scan
from quireflow.plans.registry import sql_view
from quireflow.sources.tables import table, table_bytes

ROW_CHARS = 48      # characters per laid out row
COLUMN_ROWS = 40    # rows per column
PAGE_ROWS = 80      # rows per page (two columns)
PAGE_W, PAGE_H = 595.0, 842.0
TASK_BYTES = 1 << 18  # of the texts' files for one task, whose glyphs then fit into its memory


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines of the documents: doc_id, line_no, text, source, lang."""
    return lines_of_texts(table(spark, folder, "documents"))


def lines_of_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


sql_view("doc_lines", r"""
SELECT doc_id, source, lang, unnest(lines) AS text, CAST(unnest(range(len(lines))) AS INTEGER) AS line_no
FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS lines FROM documents)""")


def layout_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents set on a two-column grid, 48 characters a row, whole texts; one output row per laid out row.

    The row number inside the document is a running sum over its lines, taken in two levels so that one huge document
    does not become one task. Rows are dealt by page, in pieces that stay small when they grow into glyphs: what groups
    glyphs by page, row or fragment then shuffles none of them.
    """
    return set_rows(doc_lines(spark, folder)).repartition(pieces(spark, folder, "documents"), "doc_id", "page")


def pieces(spark: SparkSession, folder: str, name: str, task_bytes: int = TASK_BYTES) -> int:
    """In how many pieces a given table's rows are dealt, task_bytes of its files each."""
    return max(spark.sparkContext.defaultParallelism, -(-table_bytes(spark, folder, name) // task_bytes))


def set_rows(lines: DataFrame) -> DataFrame:
    """Lines of texts as rows of the grid."""
    lines = lines.withColumn("rows", F.regexp_extract_all("text", F.lit(r"(?s).{1,48}"), F.lit(0)))
    lines = lines.withColumn("rows", F.when(F.size("rows") == 0, F.array(F.lit(""))).otherwise(F.col("rows")))
    sizes = lines.select("doc_id", "line_no", (F.col("line_no") / 512).cast("int").alias("chunk"),
                         F.size("rows").cast("long").alias("n"))
    first = scan.running(sizes, ["doc_id"], ["chunk"], ["line_no"], sums={"upto": F.col("n")}).select(
        "doc_id", "line_no", (F.col("upto") - F.col("n")).alias("first_row"))
    # the texts are spread by line before they grow into rows and glyphs; the join needs this distribution anyway
    rows = (
        lines.repartition("doc_id", "line_no").join(first, ["doc_id", "line_no"])
        .select("doc_id", "line_no", "source", "lang", "first_row", F.posexplode("rows").alias("wrap", "text"))
        .withColumn("row_no", (F.col("first_row") + F.col("wrap")).cast("int"))
        .where(F.length(F.trim("text")) > 0)
    )
    return place_rows(rows).select(
        "doc_id", "line_no", "wrap", "row_no", "source", "lang", "page", "col", "text", "x0", "y0", "x1", "y1", "size")


def place_rows(rows: DataFrame) -> DataFrame:
    """Grid coordinates of numbered rows."""
    in_page = F.col("row_no") % PAGE_ROWS
    lead = F.length("text") - F.length(F.ltrim("text"))
    left = F.lit(36.0) + F.col("col") * 270
    return (
        rows.withColumn("page", F.floor(F.col("row_no") / PAGE_ROWS).cast("int") + 1)
        .withColumn("col", F.floor(in_page / COLUMN_ROWS).cast("int"))
        .withColumn("size", F.when(F.col("line_no") == 0, 12.0).otherwise(10.0))
        .withColumn("y0", F.lit(70.0) + (in_page % COLUMN_ROWS) * 14)
        .withColumn("y1", F.col("y0") + F.col("size"))
        .withColumn("x0", left + lead * 5)
        .withColumn("x1", left + F.length(F.rtrim("text")) * 5)
    )


sql_view("layout_rows", r"""
SELECT doc_id, line_no, wrap, row_no, source, lang, page, col, text, size,
       36.0::DOUBLE + 270 * col + 5 * (length(text) - length(ltrim(text))) AS x0,
       70.0::DOUBLE + 14 * (row_no % 40) AS y0,
       36.0::DOUBLE + 270 * col + 5 * length(rtrim(text)) AS x1,
       70.0::DOUBLE + 14 * (row_no % 40) + size AS y1
FROM (
  SELECT doc_id, line_no, CAST(wrap AS INTEGER) AS wrap, CAST(first_row + wrap AS INTEGER) AS row_no, source, lang,
         CAST((first_row + wrap) // 80 + 1 AS INTEGER) AS page,
         CAST(((first_row + wrap) % 80) // 40 AS INTEGER) AS col,
         CAST(CASE WHEN line_no = 0 THEN 12 ELSE 10 END AS DOUBLE) AS size,
         substr(full_text, wrap * 48 + 1, 48) AS text
  FROM (
    SELECT doc_id, line_no, source, lang, text AS full_text, first_row, unnest(range(n)) AS wrap
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) - n AS first_row
          FROM (SELECT *, CAST(greatest(1, (length(text) + 47) // 48) AS BIGINT) AS n FROM doc_lines))))
WHERE length(trim(text)) > 0""", ("doc_lines",))


def glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per drawn character of layout_rows; white space is not drawn."""
    return explode_glyphs(layout_rows(spark, folder))


def explode_glyphs(rows: DataFrame) -> DataFrame:
    chars = rows.select(
        "doc_id", "page", "col", "line_no", "row_no", "lang", "y0", "y1", "size",
        F.posexplode(F.split("text", "")).alias("pos", "c")).where(F.trim("c") != "")
    code = F.ascii("c")
    left = F.lit(36.0) + F.col("col") * 270 + F.col("pos") * 5
    font = F.create_map(*[F.lit(v) for pair in FONTS.items() for v in pair])[F.col("lang")]
    return chars.select(
        "doc_id", "page", "col", F.col("row_no").alias("frag"), F.col("pos").alias("gno"), "c",
        left.alias("x0"), "y0", (left + 5).alias("x1"), "y1", "size", font.alias("font"),
        F.when(F.col("line_no") == 0, 16).otherwise(0).alias("flags"), (code % 4 * 16).cast("int").alias("char_flags"),
        (code * 65793 % 16777216).cast("int").alias("rgb"), (code % 10 / 100).alias("ink"))


FONTS = {"en": "BodyText", "de": "HeadEB", "fr": "SerifSemiBold", "es": "SansBold"}

sql_view("glyphs", r"""
SELECT doc_id, page, col, row_no AS frag, gno, c, 36.0::DOUBLE + 270 * col + 5 * gno AS x0, y0,
       36.0::DOUBLE + 270 * col + 5 * gno + 5 AS x1, y1, size,
       CASE lang WHEN 'en' THEN 'BodyText' WHEN 'de' THEN 'HeadEB' WHEN 'fr' THEN 'SerifSemiBold'
                 WHEN 'es' THEN 'SansBold' END AS font,
       CASE WHEN line_no = 0 THEN 16 ELSE 0 END AS flags, CAST(ascii(c) % 4 * 16 AS INTEGER) AS char_flags,
       CAST(CAST(ascii(c) AS BIGINT) * 65793 % 16777216 AS INTEGER) AS rgb, (ascii(c) % 10) / 100.0::DOUBLE AS ink
FROM (SELECT *, unnest(string_split(text, '')) AS c, CAST(unnest(range(length(text))) AS INTEGER) AS gno
      FROM layout_rows)
WHERE trim(c) <> ''""", ("layout_rows",))


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of layout_rows as text fragments: pitch 45 points, short words leave wide gaps, heights jitter by 0-2."""
    rows = layout_rows(spark, folder)
    out = rows.select("doc_id", "page", "col", "row_no", "size", F.col("y0").alias("top"),
                      F.posexplode(F.split(F.trim("text"), " +")).alias("word_no", "text"))
    left = F.lit(36.0) + F.col("col") * 3000 + F.col("word_no") * 45
    top = F.col("top") + F.col("word_no") % 3
    return out.select("doc_id", "page", "col", "row_no", "word_no", "text", left.alias("x0"), top.alias("y0"),
                      (left + F.least(F.lit(44), F.length("text") * 4)).alias("x1"), (top + 10).alias("y1"), "size")


sql_view("words", r"""
SELECT doc_id, page, col, row_no, word_no, text, size, 36.0::DOUBLE + 3000 * col + 45 * word_no AS x0,
       top + word_no % 3 AS y0, 36.0::DOUBLE + 3000 * col + 45 * word_no + least(44, 4 * length(text)) AS x1,
       top + word_no % 3 + 10 AS y1
FROM (SELECT doc_id, page, col, row_no, size, y0 AS top, unnest(ws) AS text,
             CAST(unnest(range(len(ws))) AS INTEGER) AS word_no
      FROM (SELECT *, string_split_regex(trim(text), ' +') AS ws FROM layout_rows))""", ("layout_rows",))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents: system = guide, k-th user turn = question k, k-th assistant turn = answer k."""
    conv = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), "role", "text",
        F.floor(F.col("turn") / 1024).cast("int").alias("chunk"))
    counted = scan.running(conv, ["doc_id", "role"], ["chunk"], ["ord"], sums={"number": F.lit(1).cast("long")})
    kind = F.when(F.col("role") == "system", "guide").when(F.col("role") == "user", "question").otherwise("answer")
    number = F.col("number").cast("int")
    shown = (F.when(F.col("role") == "system", F.concat(F.lit("※ "), F.col("text")))
             .when(F.col("role") == "user", F.concat(number, F.lit(". "), F.col("text")))
             .otherwise(F.concat(number, F.lit(") [정답] "), F.col("text"))))
    return counted.select("doc_id", "ord", "chunk", kind.alias("kind"), number.alias("number"), shown.alias("text"))


sql_view("turns", r"""
SELECT doc_id, ord, kind, number, CASE kind WHEN 'guide' THEN '※ ' || text WHEN 'question' THEN number || '. ' || text
       ELSE number || ') [정답] ' || text END AS text
FROM (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord, text,
             CASE role WHEN 'system' THEN 'guide' WHEN 'user' THEN 'question' ELSE 'answer' END AS kind,
             CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS number
      FROM conversations)""")


def turn_rows(spark: SparkSession, folder: str) -> DataFrame:
    """turns set on the page grid as a workbook: guides and questions first, all answers behind them; question heads are large."""
    flat = turns(spark, folder).withColumn("text", F.regexp_replace("text", "\n", " "))
    answers = (F.col("kind") == "answer").cast("int")
    rows = flat.withColumns({"section": answers, "rows": F.regexp_extract_all("text", F.lit(r"(?s).{1,48}"), F.lit(0))})
    sizes = rows.select("doc_id", "section", "chunk", "ord", F.size("rows").cast("long").alias("n"))
    first = scan.running(sizes, ["doc_id"], ["section", "chunk"], ["ord"], sums={"upto": F.col("n")}).select("doc_id", "ord", (F.col("upto") - F.col("n")).alias("first_row"))
    placed = rows.join(first, ["doc_id", "ord"]).select("doc_id", "ord", "kind", "number", "first_row", F.posexplode("rows").alias("wrap", "text"))
    placed = placed.withColumns({"row_no": (F.col("first_row") + F.col("wrap")).cast("int"), "lang": F.lit("en"),
                                 "line_no": F.when((F.col("kind") == "question") & (F.col("wrap") == 0), 0).otherwise(1)})
    return place_rows(placed.where(F.length(F.trim("text")) > 0)).drop("first_row")


sql_view("turn_rows", r"""
SELECT *, CAST(row_no // 80 + 1 AS INTEGER) AS page, CAST(row_no % 80 // 40 AS INTEGER) AS col, 70 + 14 * (row_no % 40) AS y0, 70 + 14 * (row_no % 40) + CASE WHEN kind = 'question' AND wrap = 0 THEN 12 ELSE 10 END AS y1
FROM (SELECT doc_id, ord, kind, number, CAST(wrap AS INTEGER) AS wrap, CAST(first_row + wrap AS INTEGER) AS row_no, substr(text, wrap * 48 + 1, 48) AS text
      FROM (SELECT *, unnest(range(n)) AS wrap FROM (
            SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY kind = 'answer', ord) AS BIGINT) - n AS first_row
            FROM (SELECT doc_id, ord, kind, number, replace(text, chr(10), ' ') AS text, CAST((length(text) + 47) // 48 AS BIGINT) AS n FROM turns))))
WHERE length(trim(text)) > 0""", ("turns",))


def grid_pages(rows: DataFrame) -> DataFrame:
    """The pages of rows on the grid."""
    return rows.groupBy("doc_id", "page").agg(F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"), F.lit(298.0).alias("split_x"),
                                              F.lit(60.0).alias("top"), F.lit(780.0).alias("bottom"))


EVENT_NAMES = {"signup": "join", "view": "upload", "click": "download", "purchase": "convert", "error": "error"}


def usage_rows(events: DataFrame) -> DataFrame:
    """Usage log rows from the events table or an events stream."""
    name = F.create_map(*[F.lit(v) for pair in EVENT_NAMES.items() for v in pair])[F.col("event_type")]
    status = F.when(F.col("value") > 100, "FAIL").when(F.col("value") > 50, "WARN").otherwise("PASS")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), name.alias("event"), F.col("user_id").cast("string").alias("user"),
        F.lit(1).alias("files"), F.get_json_object("props", "$.k").cast("int").alias("pages"),
        F.floor("value").cast("int").alias("questions"), status.alias("status"), F.col("value").alias("seconds"),
        F.from_json("props", "map<string,string>").alias("detail"))


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage_rows(table(spark, folder, "events"))


sql_view("usage", r"""
SELECT event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'join' WHEN 'view' THEN 'upload' WHEN 'click'
       THEN 'download' WHEN 'purchase' THEN 'convert' ELSE 'error' END AS event, CAST(user_id AS VARCHAR) AS "user",
       1 AS files, CAST(json_extract_string(props, '$.k') AS INTEGER) AS pages,
       CAST(floor(value) AS INTEGER) AS questions,
       CASE WHEN value > 100 THEN 'FAIL' WHEN value > 50 THEN 'WARN' ELSE 'PASS' END AS status, value AS seconds, props
FROM events""")


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that count as failed (quality 0 or toxic 1): one row per failed conversion."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    bad = labels.where("quality = 0 or toxic = 1")
    ts = F.lit(1704067200).cast("long") + F.col("doc_id") * 60
    return docs.join(bad, "doc_id").select(
        "doc_id", F.substring(F.sha2(F.concat(F.lit("convert:"), F.sha2("text", 256)), 256), 1, 20).alias("key"),
        F.lit("convert").alias("kind"), ts.alias("ts"), F.col("source").alias("user"),
        F.when(F.col("toxic") == 1, "ERROR").otherwise("FAIL").alias("status"), "lang",
        F.col("n_chars").alias("size"), (F.col("quality") == 0).alias("has_result"),
        F.substring_index("text", "\n", 1).alias("cause"), F.col("text").alias("error"))


sql_view("failures", r"""
SELECT d.doc_id, substr(sha256('convert:' || sha256(text)), 1, 20) AS key, 'convert' AS kind,
       1704067200 + d.doc_id * 60 AS ts, source AS "user", CASE WHEN toxic = 1 THEN 'ERROR' ELSE 'FAIL' END AS status,
       lang, n_chars AS size, quality = 0 AS has_result, string_split(text, chr(10))[1] AS cause, text AS error
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0 OR toxic = 1""")


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered items: document = order, number = line number, in the order of the line item keys.

    One order's items are one small group in the benchmark schema, but the position is still taken in two levels
    (chunk = line number), so that a single order holding very many items is spread.
    """
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number"), "l_partkey", "l_suppkey",
        "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_extendedprice")
    out = scan.numbered(items, ["doc_id"], ["number"], ["l_partkey", "l_suppkey", "l_extendedprice"], "ord")
    return out.withColumn("ord", F.col("ord").cast("int"))


sql_view("numbers", r"""
SELECT l_orderkey AS doc_id, l_linenumber AS number, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag,
       l_linestatus, l_extendedprice,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
            AS INTEGER) AS ord
FROM lineitem""")


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals on a line per part."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("grp"), F.col("l_quantity").alias("start"),
        (F.col("l_quantity") + 10 * F.col("l_discount") + 0.5).alias("end"), "l_orderkey", "l_linenumber")


sql_view("intervals", r"""
SELECT l_partkey AS grp, l_quantity AS start, l_quantity + 10 * l_discount + 0.5 AS "end", l_orderkey, l_linenumber
FROM lineitem""")


def grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One table grid per order; one cell is missing where the key is divisible by 7, one doubled where it leaves 1."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("rows"),
        (F.col("o_custkey") % 4 + 1).cast("int").alias("cols"))
    cells = (
        orders.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    )
    corner = (F.col("row") == 0) & (F.col("col") == 0)
    copies = (F.when(corner & (F.col("table_id") % 7 == 0), 0).when(corner & (F.col("table_id") % 7 == 1), 2)
              .otherwise(1))
    return cells.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(
        "table_id", "rows", "cols", "row", "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))


sql_view("grid_cells", r"""
SELECT table_id, rows, cols, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, 1 AS rowspan, 1 AS colspan
FROM (SELECT table_id, rows, cols, r, unnest(range(cols)) AS c
      FROM (SELECT o_orderkey AS table_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS rows,
                   CAST(o_custkey % 4 + 1 AS INTEGER) AS cols, unnest(range(o_orderkey % 4 + 1)) AS r FROM orders)),
     LATERAL (SELECT unnest(range(CASE WHEN r = 0 AND c = 0 AND table_id % 7 = 0 THEN 0
                                       WHEN r = 0 AND c = 0 AND table_id % 7 = 1 THEN 2 ELSE 1 END)) AS copy)""")


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles on pages, one per line item; four neighbouring orders share a page.

    The role columns (l_linestatus, l_returnflag) let one table serve as boxes, fills, images, glyphs or segments.
    """
    items = table(spark, folder, "lineitem").select(
        F.floor(F.col("l_orderkey") / 16).alias("doc_id"),
        (F.floor(F.col("l_orderkey") / 4) % 4 + 1).cast("int").alias("page"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    items = scan.numbered(items, ["doc_id", "page"], ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], "sid")
    left = F.lit(36.0) + F.col("l_partkey") % 400
    top = F.lit(60.0) + (F.col("l_suppkey") * 37 + F.col("l_linenumber") * 101) % 640
    return items.select(
        "doc_id", "page", F.col("sid").cast("int"), "flag", "status", left.alias("x0"), top.alias("y0"),
        (left + 20 + F.col("l_quantity") * 4).alias("x1"), (top + 10 + F.col("l_partkey") % 7 * 20).alias("y1"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("disc"), F.col("l_quantity").alias("qty"))


sql_view("shapes", r"""
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS sid, flag, status, x0, y0,
       x0 + 20 + l_quantity * 4 AS x1, y0 + 10 + l_partkey % 7 * 20 AS y1, l_partkey AS part, l_suppkey AS supp,
       CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS disc, l_quantity AS qty
FROM (SELECT l_orderkey // 16 AS doc_id, CAST((l_orderkey // 4) % 4 + 1 AS INTEGER) AS page, *,
             l_returnflag AS flag, l_linestatus AS status, 36.0::DOUBLE + l_partkey % 400 AS x0,
             60.0::DOUBLE + (l_suppkey * 37 + l_linenumber * 101) % 640 AS y0 FROM lineitem)""")
