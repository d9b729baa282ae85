"""Boxes, tables, brackets and pictures over pages of shapes derived from whole tables."""

from pyspark.sql import functions as F

from quireflow.functions import text as tx
from quireflow.operators import shapes as ops
from quireflow.plans.registry import query, sql_view
from quireflow.sources import corpus
from quireflow.sources.corpus import table

PAGE = ["doc_id", "page"]


def shapes(spark, folder):
    return corpus.shapes(spark, folder)


def role(df, flag, status=None):
    out = df.where(F.col("flag") == flag)
    return out.where(F.col("status") == status) if status else out


def one_page(df):
    """Page facts of every page."""
    return df.select(*PAGE).distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0), "top": F.lit(100.0), "bottom": F.lit(700.0)})


@query("images_deduped", "C4", """
SELECT doc_id, page, digest, arg_min(img, img) AS img FROM (SELECT doc_id, page, sid AS img, part % 3 AS digest, supp % 2 * 1.0 AS x0, flag AS f FROM shapes WHERE qty >= 2) GROUP BY doc_id, page, digest, x0, f""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    x0 = F.col("supp") % 2 + F.col("part") % 2 * 0.01
    y0 = F.ascii("flag") * 1.0
    images = s.select(*PAGE, F.col("sid").alias("img"), (F.col("part") % 3).alias("digest"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(F.col("qty") >= 2, 30).otherwise(0.5)).alias("x1"), (y0 + 30).alias("y1"))
    return ops.dedupe_images(images).select(*PAGE, "digest", "img")


def path_items(spark, folder):
    s = shapes(spark, folder)
    op = F.when(F.col("flag") == "A", "l").when(F.col("flag") == "N", "re").when(F.col("status") == "O", "qu").otherwise("c")
    shade = F.col("disc") / 10.0
    return s.select(*PAGE, F.col("sid").alias("draw_ord"), F.lit(0).alias("item_ord"), op.alias("op"), "x0", "y0", F.when(F.col("qty") < 5, F.col("x0") + 1).otherwise(F.col("x1")).alias("x1"), "y1",
                    F.lit(1.0).alias("width"), F.when(F.col("supp") % 2 == 0, "f").otherwise("s").alias("type"), F.when(F.col("supp") % 2 == 0, F.array(shade, shade, shade)).alias("fill"), F.lit(1.0).alias("fill_opacity"))


sql_view("path_items", """
SELECT doc_id, page, sid AS draw_ord, CASE WHEN flag = 'A' THEN 'l' WHEN flag = 'N' THEN 're' WHEN status = 'O' THEN 'qu' ELSE 'c' END AS op, x0, y0, CASE WHEN qty < 5 THEN x0 + 1 ELSE x1 END AS x1, y1,
       supp % 2 = 0 AS filled, disc / 10.0::DOUBLE AS shade FROM shapes""", ("shapes",))


@query("path_segments", "C5", """
SELECT doc_id, page, draw_ord, CASE WHEN op = 'c' THEN 0 WHEN op = 'l' OR (op = 're' AND x1 - x0 < 1.5) THEN 1 ELSE 4 END AS segments,
       CASE WHEN op = 'c' OR (op = 're' AND NOT x1 - x0 < 1.5) THEN 1 ELSE 0 END AS others FROM path_items WHERE NOT (filled AND shade > 0.97)""", ("path_items",))
def _(spark, folder):
    items = ops.visible_items(path_items(spark, folder))
    segments, others = ops.to_segments(items)
    both = segments.select(*PAGE, "draw_ord", F.lit(1).alias("s"), F.lit(0).alias("o")).unionByName(others.select(*PAGE, "draw_ord", F.lit(0).alias("s"), F.lit(1).alias("o")))
    return both.groupBy(*PAGE, "draw_ord").agg(F.sum("s").cast("int").alias("segments"), F.sum("o").cast("int").alias("others"))


@query("page_fills", "C6", """
SELECT doc_id, page, draw_ord, CASE WHEN shade <= 0.97 THEN printf('#%02X%02X%02X', round_even(shade * 255, 0)::INT, round_even(shade * 255, 0)::INT, round_even(shade * 255, 0)::INT) ELSE '' END AS color
FROM path_items WHERE filled AND op = 're' AND x1 - x0 > 3""", ("path_items",))
def _(spark, folder):
    return ops.fills(path_items(spark, folder)).select(*PAGE, "draw_ord", F.coalesce("color", F.lit("")).alias("color"))


@query("dotted_lines_joined", "C7", """
WITH d AS (SELECT DISTINCT l_suppkey AS page, l_linenumber * 0.5::DOUBLE AS pos, l_partkey % 400 * 1.0::DOUBLE AS y0, l_partkey % 400 + 1.0::DOUBLE AS y1 FROM lineitem)
SELECT page, pos AS x0, min(y0) AS y0, max(y1) AS y1, count(*) AS dots FROM (
 SELECT *, sum(n) OVER (PARTITION BY page, pos ORDER BY y0) AS run FROM (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY page, pos ORDER BY y0) <= 3 THEN 0 ELSE 1 END AS n FROM d))
GROUP BY page, pos, run HAVING count(*) >= 5 AND max(y1) - min(y0) >= 20""")
def _(spark, folder):
    y = F.col("l_partkey") % 400 * 1.0
    dots = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("page"), F.lit(0).alias("doc_id"), (F.col("l_linenumber") * 0.5).alias("x0"), y.alias("y0"),
                                                   (F.col("l_linenumber") * 0.5 + 0.4).alias("x1"), (y + 1.0).alias("y1")).distinct()
    return ops.join_dots(dots).drop("doc_id")


@query("interval_runs_merged", "C8", """
WITH RECURSIVE iv AS (SELECT l_partkey AS grp, l_suppkey % 12 * 0.6::DOUBLE AS v, l_quantity AS s, l_quantity + 10 * l_discount + 0.5 AS e FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS k FROM (SELECT DISTINCT grp, v FROM iv)),
walk AS (SELECT grp, k, v, v AS anchor FROM p WHERE k = 1 UNION ALL SELECT p.grp, p.k, p.v, CASE WHEN p.v - w.anchor <= 1.0 THEN w.anchor ELSE p.v END FROM walk w JOIN p ON p.grp = w.grp AND p.k = w.k + 1)
SELECT grp, anchor AS pos, min(s) AS start, max(e) AS "end" FROM (
 SELECT *, sum(n) OVER (PARTITION BY grp, anchor ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT i.grp, w.anchor, i.s, i.e, CASE WHEN i.s > max(i.e) OVER (PARTITION BY i.grp, w.anchor ORDER BY i.s, i.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS n
  FROM iv i JOIN walk w ON w.grp = i.grp AND w.v = i.v)) GROUP BY grp, anchor, run""")
def _(spark, folder):
    iv = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("grp"), (F.col("l_suppkey") % 12 * 0.6).alias("pos"), F.col("l_quantity").alias("start"),
                                                 (F.col("l_quantity") + 10 * F.col("l_discount") + 0.5).alias("end"))
    return ops.merge_runs(iv, ["grp"])


@query("content_bands", "C9", """
SELECT p.doc_id, p.page, coalesce(top, 0.0) AS top, coalesce(bottom, 842.0) AS bottom FROM (SELECT DISTINCT doc_id, page FROM shapes) p LEFT JOIN (
 SELECT doc_id, page, max(CASE WHEN flag = 'A' AND y1 <= 168.4 THEN y1 WHEN flag = 'N' AND y0 <= 0.12 * 842 THEN y0 END) AS top,
        min(CASE WHEN flag = 'A' AND y0 >= 0.8 * 842 THEN y0 WHEN flag = 'N' AND y0 >= 0.88 * 842 THEN y0 END) AS bottom FROM shapes WHERE flag <> 'R' AND (x1 - x0) * 4 >= 357 GROUP BY ALL) b
ON b.doc_id = p.doc_id AND b.page = p.page""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder).withColumn("x1", F.col("x0") + (F.col("x1") - F.col("x0")) * 4)
    pages = one_page(s).drop("top", "bottom")
    rules = role(s, "N").withColumn("y1", F.col("y0"))
    return ops.content_band(pages, role(s, "A"), rules).select(*PAGE, "top", "bottom")


@query("column_dividers", "C11", """
WITH v AS (SELECT doc_id, page, sid, x0, y0, y0 + qty * 12 AS y1 FROM shapes WHERE qty * 12 >= 3),
l AS (SELECT *, least(y1, 700) - greatest(y0, 100) AS len FROM v WHERE x0 BETWEEN 0.35 * 595 AND 0.65 * 595),
b AS (SELECT doc_id, page, arg_max(x0, (len, -sid)) AS split FROM l WHERE len >= 240 GROUP BY ALL),
o AS (SELECT p.doc_id, p.page, coalesce(split, 297.5) AS sx, split IS NOT NULL AS divided FROM (SELECT DISTINCT doc_id, page FROM shapes) p LEFT JOIN b ON b.doc_id = p.doc_id AND b.page = p.page)
SELECT o.doc_id, o.page, sx AS split_x, divided, CASE WHEN divided THEN coalesce(min(y0), 100.0) ELSE 100.0 END AS div_y0, CASE WHEN divided THEN coalesce(max(y1), 700.0) ELSE 700.0 END AS div_y1
FROM o LEFT JOIN v ON v.doc_id = o.doc_id AND v.page = o.page AND abs(v.x0 - sx) < 1 AND v.y1 - v.y0 >= 150 GROUP BY o.doc_id, o.page, sx, divided""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    v = s.select(*PAGE, F.col("sid").alias("ord"), "x0", "y0", F.col("x0").alias("x1"), (F.col("y0") + F.col("qty") * 12).alias("y1"))
    return ops.column_split(one_page(s), v).select(*PAGE, "split_x", "divided", "div_y0", "div_y1")


@query("single_column_pages", "C12", """
WITH it AS (SELECT doc_id, page, CASE flag WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' ELSE 'other' END AS kind, qty AS g, x0, y0, x1, y1, x0 < 287.5 AND x1 > 307.5 AS cr FROM shapes WHERE flag <> 'N' OR qty > 40),
ins AS (SELECT *, greatest(100.0, y0) AS s, least(700.0, y1) AS e FROM it WHERE y1 > 100 AND y0 < 700),
cov AS (SELECT doc_id, page, sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS len FROM (SELECT *, max(e) OVER (PARTITION BY doc_id, page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ins) GROUP BY ALL),
cro AS (SELECT doc_id, page, sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS len FROM (SELECT *, max(e) OVER (PARTITION BY doc_id, page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ins WHERE cr) GROUP BY ALL),
f AS (SELECT doc_id, page, coalesce(sum(g) FILTER (kind = 'text'), 0) AS n_all, coalesce(sum(g) FILTER (kind = 'text' AND cr), 0) AS n_cr, bool_or(kind = 'table' AND cr) AS t FROM it GROUP BY ALL)
SELECT p.doc_id, p.page, coalesce(p.page <> 2 AND (t OR n_cr >= 0.1 * greatest(1, n_all)) AND cov.len >= 90 AND coalesce(cro.len, 0) >= 0.3 * cov.len, false) AS single
FROM (SELECT DISTINCT doc_id, page FROM shapes) p LEFT JOIN f ON f.doc_id = p.doc_id AND f.page = p.page LEFT JOIN cov ON cov.doc_id = p.doc_id AND cov.page = p.page LEFT JOIN cro ON cro.doc_id = p.doc_id AND cro.page = p.page""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    items = s.where("flag <> 'N' or qty > 40").select(*PAGE, F.when(F.col("flag") == "A", "text").when(F.col("flag") == "N", "table").otherwise("other").alias("kind"), F.col("qty").alias("glyphs"), "x0", "y0", "x1", "y1")
    pages = one_page(s).withColumn("divided", F.col("page") == 2)
    return ops.is_single_column(pages, items).select(*PAGE, "single")


def stroke_pairs(spark, folder):
    """Upright strokes: each shape draws its left and right side."""
    s = shapes(spark, folder)
    side = lambda c: s.select(*PAGE, F.col(c).alias("x0"), "y0", F.col(c).alias("x1"), "y1")
    return side("x0").unionByName(side("x1"))


@query("boxes_detected", "C16", """
WITH RECURSIVE raw AS (SELECT doc_id, page, x0 AS x, y0, y1 FROM shapes UNION ALL SELECT doc_id, page, x1, y0, y1 FROM shapes),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x) AS k FROM (SELECT DISTINCT doc_id, page, x FROM raw)),
wk AS (SELECT doc_id, page, k, x, x AS anchor FROM p WHERE k = 1 UNION ALL SELECT p.doc_id, p.page, p.k, p.x, CASE WHEN p.x - w.anchor <= 1.0 THEN w.anchor ELSE p.x END FROM wk w JOIN p ON p.doc_id = w.doc_id AND p.page = w.page AND p.k = w.k + 1),
m AS (SELECT doc_id, page, anchor AS x, min(y0) AS y0, max(y1) AS y1 FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, page, anchor ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT r.doc_id, r.page, w.anchor, r.y0, r.y1, CASE WHEN r.y0 > max(r.y1) OVER (PARTITION BY r.doc_id, r.page, w.anchor ORDER BY r.y0, r.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS n
  FROM raw r JOIN wk w ON w.doc_id = r.doc_id AND w.page = r.page AND w.x = r.x)) GROUP BY doc_id, page, anchor, run),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x, y0, y1) AS k FROM m WHERE y1 - y0 >= 8),
pick AS (
 SELECT DISTINCT doc_id, page, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS mate FROM s
 UNION ALL
 SELECT a.doc_id, a.page, a.k, CASE WHEN b IS NULL THEN used ELSE list_concat(used, [a.k, b]) END, b FROM (
  SELECT s.doc_id, s.page, s.k, w.used, (SELECT arg_min(c.k, (round_even((abs(c.y0 - s.y0) + abs(c.y1 - s.y1)) / 1.5, 0), c.x, c.k)) FROM s c WHERE c.doc_id = s.doc_id AND c.page = s.page AND c.x > s.x + 40
      AND abs(c.y0 - s.y0) <= 5 AND abs(c.y1 - s.y1) <= 5 AND NOT list_contains(w.used, c.k) AND NOT list_contains(w.used, s.k)) AS b
  FROM pick w JOIN s ON s.doc_id = w.doc_id AND s.page = w.page AND s.k = w.k + 1) a)
SELECT a.doc_id, a.page, a.x AS x0, greatest(a.y0, b.y0) AS y0, b.x AS x1, least(a.y1, b.y1) AS y1 FROM pick JOIN s a ON a.doc_id = pick.doc_id AND a.page = pick.page AND a.k = pick.k JOIN s b ON b.doc_id = pick.doc_id AND b.page = pick.page AND b.k = pick.mate""", ("shapes",))
def _(spark, folder):
    return ops.detect_boxes(stroke_pairs(spark, folder)).drop("box")


def big_boxes(s):
    """Every shape of flag A or N as a box; those of flag A are blown up, so that they hold others."""
    grow = F.when(F.col("flag") == "A", 150).otherwise(0)
    return s.where("flag <> 'R'").select(*PAGE, F.col("sid").alias("box"), (F.col("x0") - grow).alias("x0"), (F.col("y0") - grow).alias("y0"), (F.col("x1") + grow).alias("x1"), (F.col("y1") + grow).alias("y1"), "flag", "status", "qty")


sql_view("big_boxes", """
SELECT doc_id, page, sid AS box, x0 - g AS x0, y0 - g AS y0, x1 + g AS x1, y1 + g AS y1, flag, status, qty, (x1 - x0 + 2 * g) * (y1 - y0 + 2 * g) AS a
FROM (SELECT *, CASE WHEN flag = 'A' THEN 150 ELSE 0 END AS g FROM shapes WHERE flag <> 'R')""", ("shapes",))


@query("page_frames", "C17", """
SELECT doc_id, page, count(*) FILTER (x1 - x0 >= 357 AND y1 - y0 >= 505.2 AND y0 <= 102 AND y1 >= 698) AS frames FROM (SELECT doc_id, page, x0, x1, y0 - 300 AS y0, y1 + 300 AS y1 FROM big_boxes) GROUP BY ALL""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    boxes = big_boxes(s).withColumns({"y0": F.col("y0") - 300, "y1": F.col("y1") + 300})
    return ops.content_boxes(boxes, one_page(s))[1]


@query("content_boxes", "C17", """
SELECT doc_id, page, box FROM big_boxes WHERE NOT (x1 - x0 >= 357 AND y1 - y0 >= 505.2 AND y0 <= 102 AND y1 >= 698) AND (y0 + y1) / 2 > 100 AND (y0 + y1) / 2 < 700""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    return ops.content_boxes(big_boxes(s), one_page(s))[0].select(*PAGE, "box")


NEST = """
SELECT b.doc_id, b.page, b.box, coalesce(h.host, 0) AS host, coalesce(inset, false) AS inset FROM big_boxes b LEFT JOIN (
 SELECT a.doc_id, a.page, a.box, min(o.box) AS host, arg_min(least(a.x0 - o.x0, a.y0 - o.y0, o.x1 - a.x1, o.y1 - a.y1) >= 0 AND greatest(a.x0 - o.x0, a.y0 - o.y0, o.x1 - a.x1, o.y1 - a.y1) <= 12, o.box) AS inset
 FROM big_boxes a JOIN big_boxes o ON a.doc_id = o.doc_id AND a.page = o.page AND a.box <> o.box AND a.x0 >= o.x0 - 1 AND a.x1 <= o.x1 + 1 AND a.y0 >= o.y0 - 1 AND a.y1 <= o.y1 + 1 AND a.a < o.a GROUP BY ALL) h
ON h.doc_id = b.doc_id AND h.page = b.page AND h.box = b.box"""


@query("boxes_nested", "C18", NEST, ("big_boxes",))
def _(spark, folder):
    out = ops.nest_boxes(big_boxes(shapes(spark, folder)))
    return out.select(*PAGE, "box", F.coalesce("host", F.lit(0)).alias("host"), "inset")


@query("inset_borders", "C18", f"""
WITH n AS (SELECT t.*, b.x0, b.x1 FROM ({NEST}) t JOIN big_boxes b ON b.doc_id = t.doc_id AND b.page = t.page AND b.box = t.box)
SELECT o.doc_id, o.page, o.box, greatest(o.x0, coalesce(max(i.x0), o.x0)) AS x0, least(o.x1, coalesce(min(i.x1), o.x1)) AS x1 FROM n o LEFT JOIN n i ON i.doc_id = o.doc_id AND i.page = o.page AND i.host = o.box AND i.inset
WHERE o.host = 0 GROUP BY o.doc_id, o.page, o.box, o.x0, o.x1""", ("big_boxes",))
def _(spark, folder):
    return ops.inset_bounds(ops.nest_boxes(big_boxes(shapes(spark, folder)))).select(*PAGE, "box", "x0", "x1")


def chart_parts(spark, folder):
    """Per order up to six boxes in a row, neighbours joined by an arrow shaft except every third time."""
    o = table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("doc_id"), (F.col("o_orderkey") % 8).cast("int").alias("page"), "o_orderkey", (F.col("o_custkey") % 6).cast("int").alias("last"))
    k = o.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last"))))
    x = F.col("i") * 90.0
    boxes = k.select(*PAGE, F.col("i").alias("box"), x.alias("x0"), F.lit(100.0).alias("y0"), (x + 60).alias("x1"), F.lit(140.0).alias("y1"))
    links = k.where((F.col("i") < F.col("last")) & ((F.col("o_orderkey") + F.col("i")) % 3 != 0)).select(
        *PAGE, F.col("i").alias("seg"), (x + 62).alias("x0"), F.lit(120.0).alias("y0"), (x + 88).alias("x1"), F.lit(120.0).alias("y1"))
    return boxes, links


@query("linked_box_charts", "C19", """
WITH k AS (SELECT o_orderkey // 8 AS doc_id, CAST(o_orderkey % 8 AS INTEGER) AS page, o_orderkey, last, unnest(range(last + 1)) AS i FROM (SELECT o_orderkey, o_custkey % 6 AS last FROM orders)),
r AS (SELECT *, sum(CASE WHEN i > 0 AND (o_orderkey + i - 1) % 3 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS run FROM k)
SELECT doc_id, page, count(*) AS boxes, min(i) * 90.0::DOUBLE - 2 AS x0, max(i) * 90.0::DOUBLE + 62 AS x1 FROM r GROUP BY doc_id, page, o_orderkey, run HAVING count(*) >= 2""")
def _(spark, folder):
    out = ops.linked_boxes(*chart_parts(spark, folder))
    return out.select(*PAGE, "boxes", "x0", "x1")


def sloped_parts(spark, folder):
    """Boxes, strokes and column splits by order, five kinds in turn: a slanting link, falling or rising; linked boxes inside
    another; boxes that reach into a chart, one or two; a chart over the column split; two charts that overlap."""
    o = table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("doc_id"), (F.col("o_orderkey") % 8).cast("int").alias("page"), (F.col("o_orderkey") % 5).alias("kind"), (F.col("o_custkey") % 2 == 1).alias("odd"))
    rect = lambda k, *v: F.struct(F.lit(k).alias("k"), *[F.lit(float(x)).alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    one, two, flat = rect(1, 0, 100, 60, 140), rect(2, 120, 100, 180, 140), rect(1, 62, 120, 118, 120)
    kind = F.col("kind")
    boxes = (F.when((kind == 0) & ~F.col("odd"), F.array(one, rect(2, 120, 200, 180, 240))).when(kind == 0, F.array(one, rect(2, 120, 0, 180, 40)))
             .when(kind == 1, F.array(rect(1, 20, 100, 80, 140), rect(2, 120, 100, 180, 140), rect(3, 0, 0, 300, 300)))
             .when((kind == 2) & F.col("odd"), F.array(one, two, rect(3, 70, 130, 110, 160), rect(4, 70, 150, 112, 170))).when(kind == 2, F.array(one, two, rect(3, 70, 130, 110, 160)))
             .when(kind == 3, F.array(one, two)).otherwise(F.array(one, two, rect(3, 20, 150, 80, 190), rect(4, 140, 150, 200, 190))))
    strokes = (F.when((kind == 0) & ~F.col("odd"), F.array(rect(1, 30, 142, 150, 198))).when(kind == 0, F.array(rect(1, 30, 42, 150, 98)))
               .when(kind == 1, F.array(rect(1, 82, 120, 118, 120))).when(kind == 4, F.array(flat, rect(2, 90, 121, 90, 160), rect(3, 82, 170, 138, 170))).otherwise(F.array(flat)))
    spread = lambda column, name: o.select(*PAGE, F.explode(column).alias("s")).select(*PAGE, F.col("s.k").alias(name), "s.x0", "s.y0", "s.x1", "s.y1")
    return spread(boxes, "box"), spread(strokes, "seg"), o.select(*PAGE, F.when((kind == 3) & F.col("odd"), 90.0).alias("column_split"))


@query("linked_charts_complete", "C19", """
SELECT o_orderkey // 8 AS doc_id, CAST(o_orderkey % 8 AS INTEGER) AS page, CASE WHEN k = 4 THEN 4 ELSE 2 END AS boxes, CAST(-2 AS DOUBLE) AS x0, CAST(CASE WHEN k = 0 AND odd THEN -2 ELSE 98 END AS DOUBLE) AS y0,
       CAST(CASE WHEN k = 4 THEN 202 ELSE 182 END AS DOUBLE) AS x1, CAST(CASE WHEN k = 0 AND NOT odd THEN 242 WHEN k = 2 AND odd THEN 172 WHEN k = 2 THEN 162 WHEN k = 4 THEN 192 ELSE 142 END AS DOUBLE) AS y1
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey % 2 = 1 AS odd FROM orders) WHERE k <> 1 AND NOT (k = 3 AND odd)""")
def _(spark, folder):
    return ops.linked_boxes(*sloped_parts(spark, folder)).select(*PAGE, "boxes", "x0", "y0", "x1", "y1")


@query("box_colours", "C20", """
WITH e AS (SELECT b.doc_id, b.page, b.box, s.status AS c, count(*) AS n, min(s.sid) AS seen FROM big_boxes b JOIN shapes s ON s.doc_id = b.doc_id AND s.page = b.page AND s.flag = 'R'
  AND least(abs(s.y0 - b.y0), abs(s.y0 - b.y1)) < 1.5 AND s.x0 < b.x1 AND s.x1 > b.x0 GROUP BY ALL)
SELECT b.doc_id, b.page, b.box, coalesce((SELECT arg_max('#' || s.disc, s.sid) FROM shapes s WHERE s.doc_id = b.doc_id AND s.page = b.page AND s.sid % 2 = 1 AND s.x0 - 60 >= b.x0 - 2 AND s.x1 <= b.x1 + 2 AND s.y0 - 60 >= b.y0 - 2 AND s.y1 <= b.y1 + 2
       AND (s.x1 - s.x0 + 60) * (s.y1 - s.y0 + 60) >= 0.7 * b.a), '') AS fill, coalesce(arg_min(c, (-n, seen)), '') AS border
FROM big_boxes b LEFT JOIN e ON e.doc_id = b.doc_id AND e.page = b.page AND e.box = b.box GROUP BY b.doc_id, b.page, b.box, b.x0, b.x1, b.y0, b.y1, b.a""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    fills = s.where("sid % 2 = 1").select(*PAGE, F.col("sid").alias("draw_ord"), (F.col("x0") - 60).alias("x0"), (F.col("y0") - 60).alias("y0"), "x1", "y1", F.concat(F.lit("#"), F.col("disc").cast("string")).alias("color"))
    edges = role(s, "R").select(*PAGE, F.col("sid").alias("seg"), "x0", "y0", "x1", F.col("y0").alias("y1"), F.col("status").alias("color"))
    return ops.box_colors(big_boxes(s), fills, edges).select(*PAGE, "box", F.coalesce("fill", F.lit("")).alias("fill"), F.coalesce("border", F.lit("")).alias("border"))


@query("fill_areas", "C21", """
WITH w AS (SELECT * FROM shapes s WHERE flag = 'R' AND x1 - x0 >= 80 AND y1 - y0 >= 40 AND NOT EXISTS (SELECT 1 FROM shapes t WHERE t.doc_id = s.doc_id AND t.page = s.page AND t.flag = 'A' AND s.x0 >= t.x0 - 14 AND s.x1 <= t.x1 + 14 AND s.y0 >= t.y0 - 14 AND s.y1 <= t.y1 + 14)
 AND NOT EXISTS (SELECT 1 FROM shapes t WHERE t.doc_id = s.doc_id AND t.page = s.page AND t.flag = 'N' AND s.x0 >= t.x0 - 3 AND s.x1 <= t.x1 + 3 AND s.y0 >= t.y0 - 3 AND s.y1 <= t.y1 + 3))
SELECT doc_id, page, count(*) AS areas, sum(x1 - x0) AS widths FROM w GROUP BY ALL""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    fills = role(s, "R").select(*PAGE, F.col("sid").alias("draw_ord"), "x0", "y0", "x1", "y1", F.concat(F.lit("#"), F.col("sid").cast("string")).alias("color"))
    out = ops.fill_areas(fills, role(s, "A").select(*PAGE, "x0", "y0", "x1", "y1"), role(s, "N").select(*PAGE, "x0", "y0", "x1", "y1"))
    return out.groupBy(*PAGE).agg(F.count("*").alias("areas"), F.sum(F.col("x1") - F.col("x0")).alias("widths"))


@query("fill_pieces_joined", "C21", """
SELECT doc_id, page, min(x0) AS x0, max(x1) AS x1, any_value(color) AS color FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, page ORDER BY sid) AS k FROM (
 SELECT *, CASE WHEN lag(color) OVER w = color AND abs(lag(x1) OVER w - x0) < 3 THEN 0 ELSE 1 END AS n FROM (
  SELECT doc_id, page, sid, sid * 100.0::DOUBLE + supp % 2 * 5 AS x0, sid * 100.0::DOUBLE + 98 + supp % 2 * 5 AS x1, flag AS color FROM shapes) WINDOW w AS (PARTITION BY doc_id, page ORDER BY sid))) GROUP BY doc_id, page, k""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    x0 = F.col("sid") * 100.0 + F.col("supp") % 2 * 5
    fills = s.select(*PAGE, F.col("sid").alias("draw_ord"), x0.alias("x0"), F.lit(50.0).alias("y0"), (x0 + 98).alias("x1"), F.lit(100.0).alias("y1"), F.col("flag").alias("color"))
    none = s.where("sid < 0").select(*PAGE, "x0", "y0", "x1", "y1")
    return ops.fill_areas(fills, none, none).select(*PAGE, "x0", "x1", "color")


def ruled_tables(spark, folder):
    """One ruled grid per order; every third order lacks the rule between its first two cells."""
    o = table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("doc_id"), (F.col("o_orderkey") % 8).cast("int").alias("page"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("rows"),
                                              (F.col("o_custkey") % 3 + 3).cast("int").alias("cols"), (F.col("o_orderkey") % 3 == 0).alias("joined"))
    r = o.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows"))))
    flat = r.select(*PAGE, F.lit(50.0).alias("x0"), (F.lit(100.0) + F.col("r") * 20).alias("y0"), (F.lit(50.0) + F.col("cols") * 30).alias("x1"), (F.lit(100.0) + F.col("r") * 20).alias("y1"))
    v = r.where(F.col("r") < F.col("rows")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols")))).where(~(F.col("joined") & (F.col("r") == 0) & (F.col("c") == 1)))
    x = F.lit(50.0) + F.col("c") * 30
    tall = v.select(*PAGE, x.alias("x0"), (F.lit(100.0) + F.col("r") * 20).alias("y0"), x.alias("x1"), (F.lit(120.0) + F.col("r") * 20).alias("y1"))
    return flat.unionByName(tall)


@query("ruled_tables", "C22", """
WITH o AS (SELECT o_orderkey // 8 AS doc_id, CAST(o_orderkey % 8 AS INTEGER) AS page, o_orderkey % 4 + 1 AS rows, o_custkey % 3 + 3 AS cols, o_orderkey % 3 = 0 AS joined FROM orders),
c AS (SELECT *, unnest(range(cols)) AS c FROM (SELECT *, unnest(range(rows)) AS r FROM o))
SELECT doc_id, page, CAST(r AS INTEGER) AS row, CAST(CASE WHEN joined AND rows = 1 AND c > 1 THEN c - 1 ELSE c END AS INTEGER) AS col, 1 AS rowspan, CASE WHEN joined AND rows > 1 AND r = 0 AND c = 0 THEN 2 ELSE 1 END AS colspan,
       50.0::DOUBLE + c * 30 AS x0, CASE WHEN joined AND r = 0 AND c = 0 THEN 110.0::DOUBLE ELSE 80.0::DOUBLE + c * 30 END AS x1 FROM c WHERE NOT (joined AND r = 0 AND c = 1)""")
def _(spark, folder):
    return ops.detect_tables(ruled_tables(spark, folder)).select(*PAGE, "row", "col", "rowspan", "colspan", "x0", "x1")


def paired_tables(spark, folder):
    """Strokes and pages by order, four kinds in turn: a table wider than 60 % of the page; one below the content band; one
    whose middle rule is the column divider; and two tables side by side, 12 or 30 points apart."""
    o = table(spark, folder, "orders").select(
        F.floor(F.col("o_orderkey") / 8).alias("doc_id"), (F.col("o_orderkey") % 8).cast("int").alias("page"), (F.col("o_orderkey") % 4).alias("kind"),
        (F.col("o_orderkey") % 5 == 0).alias("wide"), (F.col("o_custkey") % 3 + 2).cast("int").alias("rows"), (F.col("o_custkey") % 2 + 1).cast("int").alias("left"),
        (F.floor(F.col("o_custkey") / 2) % 2 + 1).cast("int").alias("right"), F.when(F.col("o_custkey") % 5 == 0, 30.0).otherwise(12.0).alias("gap"))
    side = F.struct
    paired = F.col("kind") == 3
    first = side(F.lit(50.0).alias("x"), F.when(F.col("kind") == 0, 3).when(paired, F.col("left")).otherwise(2).alias("cols"), F.when(F.col("kind") == 0, 140.0).otherwise(30.0).alias("w"))
    second = side((F.lit(50.0) + F.col("left") * 30 + F.col("gap")).alias("x"), F.col("right").alias("cols"), F.lit(30.0).alias("w"))
    t = o.withColumn("t", F.explode(F.when(paired, F.array(first, second)).otherwise(F.array(first)))).withColumn("top", F.when(F.col("kind") == 1, 600.0).otherwise(100.0))
    r = t.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("y", F.col("top") + F.col("r") * 20)
    flat = r.select(*PAGE, F.col("t.x").alias("x0"), F.col("y").alias("y0"), (F.col("t.x") + F.col("t.cols") * F.col("t.w")).alias("x1"), F.col("y").alias("y1"))
    v = r.where(F.col("r") < F.col("rows")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("t.cols")))).withColumn("x", F.col("t.x") + F.col("c") * F.col("t.w"))
    tall = v.select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), (F.col("y") + 20).alias("y1"))
    pages = o.select(*PAGE, F.lit(595.0).alias("width"), F.lit(90.0).alias("top"), F.lit(500.0).alias("bottom"), F.when(F.col("kind") == 2, F.when(F.col("wide"), 80.5).otherwise(82.0)).alias("divider"), "wide")
    return flat.unionByName(tall), pages


@query("tables_with_open_cells", "C22 C23", """
WITH o AS (SELECT o_orderkey // 8 AS doc_id, CAST(o_orderkey % 8 AS INTEGER) AS page, o_orderkey % 4 AS kind, o_orderkey % 5 = 0 AS wide, o_custkey % 3 + 2 AS rows, o_custkey % 2 + 1 AS l, o_custkey // 2 % 2 + 1 AS r, o_custkey % 5 = 0 AS apart FROM orders),
t AS (SELECT doc_id, page, rows, 0 AS base, 3 AS cols, 50.0 AS x, 140.0 AS w, -1 AS gap_col FROM o WHERE kind = 0 AND wide
 UNION ALL SELECT doc_id, page, rows, 0, 2, 50, 30, -1 FROM o WHERE kind = 2 AND NOT wide
 UNION ALL SELECT doc_id, page, rows, 0, l, 50, 30, -1 FROM o WHERE kind = 3 AND apart AND l = 2
 UNION ALL SELECT doc_id, page, rows, 0, r, 50 + l * 30 + 30, 30, -1 FROM o WHERE kind = 3 AND apart AND r = 2
 UNION ALL SELECT doc_id, page, rows, 0, l + 1 + r, 50, 30, l FROM o WHERE kind = 3 AND NOT apart),
c AS (SELECT *, unnest(range(cols)) AS c FROM (SELECT *, unnest(range(rows)) AS r FROM t))
SELECT doc_id, page, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, c = gap_col AS open, CAST(x + c * w - CASE WHEN gap_col >= 0 AND c > gap_col THEN 18 ELSE 0 END AS DOUBLE) AS x0,
       CAST(x + (c + 1) * w - CASE WHEN gap_col >= 0 AND c >= gap_col THEN 18 ELSE 0 END AS DOUBLE) AS x1, CAST(100 + r * 20 AS DOUBLE) AS y0 FROM c""")
def _(spark, folder):
    return ops.detect_tables(*paired_tables(spark, folder)).select(*PAGE, "row", "col", "open", "x0", "x1", "y0")


@query("tables_bridged", "C23", """
WITH o AS (SELECT o_orderkey // 8 AS doc_id, CAST(o_orderkey % 8 AS INTEGER) AS page, o_orderkey AS k, o_custkey % 4 + 2 AS rules, o_orderkey % 5 AS g FROM orders)
SELECT doc_id, page, r * 2 + 1 AS hid, r * 2 + 2 AS joins FROM (SELECT *, unnest(range(rules)) AS r FROM o) WHERE g >= 1 AND rules >= 3 AND k % 7 <> 0""")
def _(spark, folder):
    # two tables side by side; the gap is 2, 8, 14, 20 or 26 points; every seventh order has one rule more on the left
    o = table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("doc_id"), (F.col("o_orderkey") % 8).cast("int").alias("page"), F.col("o_orderkey").alias("k"),
                                              (F.col("o_custkey") % 4 + 2).cast("int").alias("rules"), (F.lit(2.0) + F.least(F.col("o_orderkey") % 5, F.lit(3)) * 6).alias("gap"))
    r = o.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rules") - 1)))
    y = F.lit(100.0) + F.col("r") * 20
    left = r.select(*PAGE, (F.col("r") * 2 + 1).alias("hid"), y.alias("y"), F.lit(50.0).alias("x0"), F.lit(150.0).alias("x1"))
    right = r.select(*PAGE, (F.col("r") * 2 + 2).alias("hid"), y.alias("y"), (F.lit(150.0) + F.col("gap")).alias("x0"), F.lit(300.0).alias("x1"))
    extra = o.where("k % 7 = 0").select(*PAGE, F.lit(99).alias("hid"), F.lit(105.0).alias("y"), F.lit(60.0).alias("x0"), F.lit(150.0).alias("x1"))
    v = o.select(*PAGE, F.lit(150.0).alias("x"), F.lit(100.0).alias("y0"), F.lit(400.0).alias("y1")).unionByName(o.select(*PAGE, (F.lit(150.0) + F.col("gap")).alias("x"), F.lit(100.0).alias("y0"), F.lit(400.0).alias("y1")))
    h = left.unionByName(right).unionByName(extra)
    return ops.bridge_tables(h.withColumn("hid", F.col("hid").cast("long")), v).select(*PAGE, "hid", "joins")


@query("cell_fills", "C24", """
SELECT c.doc_id, c.page, c.sid AS cell, arg_max('#' || f.disc, f.sid) AS fill FROM shapes c JOIN shapes f ON f.doc_id = c.doc_id AND f.page = c.page AND f.flag = 'R'
WHERE c.flag = 'A' AND least(c.x1, f.x1 + 100) > greatest(c.x0, f.x0 - 100) AND least(c.y1, f.y1 + 100) > greatest(c.y0, f.y0 - 100)
AND (least(c.x1, f.x1 + 100) - greatest(c.x0, f.x0 - 100)) * (least(c.y1, f.y1 + 100) - greatest(c.y0, f.y0 - 100)) >= 0.7 * ((c.x1 - c.x0) * (c.y1 - c.y0)) GROUP BY ALL""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    cells = role(s, "A").select(*PAGE, F.lit(1).alias("tbl"), F.col("sid").alias("cell"), "x0", "y0", "x1", "y1")
    tables = s.select(*PAGE).distinct().select(*PAGE, F.lit(1).alias("tbl"), F.lit(-500.0).alias("x0"), F.lit(-500.0).alias("y0"), F.lit(1500.0).alias("x1"), F.lit(1500.0).alias("y1"))
    fills = role(s, "R").select(*PAGE, F.col("sid").alias("draw_ord"), (F.col("x0") - 100).alias("x0"), (F.col("y0") - 100).alias("y0"), (F.col("x1") + 100).alias("x1"), (F.col("y1") + 100).alias("y1"), F.concat(F.lit("#"), F.col("disc").cast("string")).alias("color"))
    return ops.cell_fills(cells, tables, fills).select(*PAGE, "cell", "fill")


@query("tables_nested", "C25", """
WITH h AS (SELECT a.doc_id, a.page, a.box AS tbl, arg_min(o.box, (o.a, o.box)) AS host, any_value((a.x0 + a.x1) / 2) AS cx, any_value((a.y0 + a.y1) / 2) AS cy FROM big_boxes a JOIN big_boxes o ON a.doc_id = o.doc_id AND a.page = o.page AND a.box <> o.box
  AND a.x0 >= o.x0 - 1 AND a.x1 <= o.x1 + 1 AND a.y0 >= o.y0 - 1 AND a.y1 <= o.y1 + 1 AND (a.a < o.a OR (a.a = o.a AND a.box < o.box)) GROUP BY a.doc_id, a.page, a.box)
SELECT h.doc_id, h.page, h.tbl, h.host, CAST(CASE WHEN cx <= (b.x0 + b.x1) / 2 THEN 0 ELSE 1 END AS INTEGER) AS cell FROM h JOIN big_boxes b ON b.doc_id = h.doc_id AND b.page = h.page AND b.box = h.host WHERE cy BETWEEN b.y0 AND b.y1""", ("big_boxes",))
def _(spark, folder):
    tables = big_boxes(shapes(spark, folder)).withColumnRenamed("box", "tbl")
    mid = (F.col("x0") + F.col("x1")) / 2
    cells = tables.select(*PAGE, "tbl", F.lit(0).alias("cell"), "x0", "y0", mid.alias("x1"), "y1").unionByName(tables.select(*PAGE, "tbl", F.lit(1).alias("cell"), mid.alias("x0"), "y0", "x1", "y1"))
    return ops.nest_tables(tables, cells)


@query("points_in_cells", "C26", """
SELECT p.doc_id, p.page, p.sid, coalesce(arg_min(b.box, (b.a, b.box)), 0) AS tbl FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM shapes WHERE flag = 'R') p
LEFT JOIN big_boxes b ON b.doc_id = p.doc_id AND b.page = p.page AND cx BETWEEN b.x0 AND b.x1 AND cy BETWEEN b.y0 AND b.y1 GROUP BY p.doc_id, p.page, p.sid""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    points = role(s, "R").select(*PAGE, F.col("sid").alias("pid"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    cells = big_boxes(s).select(*PAGE, F.col("box").alias("tbl"), F.lit(0).alias("cell"), ops.area().alias("size"), "x0", "y0", "x1", "y1")
    return ops.assign_cells(points, cells).select(*PAGE, F.col("pid").alias("sid"), F.coalesce("tbl", F.lit(0)).alias("tbl"))


@query("fragments_cut_at_cells", "C26", """
SELECT doc_id, page, gno, CAST(sum(n) OVER (PARTITION BY doc_id, page ORDER BY gno) AS BIGINT) AS piece FROM (
 SELECT doc_id, page, sid AS gno, CASE WHEN tbl IS NOT DISTINCT FROM lag(tbl) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM (
  SELECT doc_id, page, sid, CASE WHEN flag <> 'R' THEN flag END AS tbl FROM shapes) WINDOW w AS (PARTITION BY doc_id, page ORDER BY sid))""", ("shapes",))
def _(spark, folder):
    points = shapes(spark, folder).select(*PAGE, F.lit(1).alias("frag"), F.col("sid").alias("gno"), F.when(F.col("flag") != "R", F.col("flag")).alias("tbl"), F.lit(None).cast("int").alias("cell"))
    return ops.cut_fragments(points).select(*PAGE, "gno", F.col("piece").cast("long"))


@query("memo_tables", "C27", """
SELECT doc_id, page, tbl FROM (SELECT doc_id, page, box AS tbl, status, qty, x1 - x0 AS w, y1 - y0 AS h FROM big_boxes) b
WHERE page % 2 = 0 AND status = 'O' AND w >= 357 AND h + 300 >= 505.2 AND EXISTS (SELECT 1 FROM shapes s WHERE s.doc_id = b.doc_id AND s.page = b.page AND s.flag = 'R' AND s.sid = b.tbl + 1)""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    tables = big_boxes(s).select(*PAGE, F.col("box").alias("tbl"), "x0", "y0", "x1", (F.col("y1") + 300).alias("y1"), F.when(F.col("status") == "O", 1).otherwise(2).alias("rows"), F.lit(2).alias("cols"))
    pages = one_page(s).withColumn("single", F.col("page") % 2 == 0)
    filled = role(s, "R").select(*PAGE, (F.col("sid") - 1).alias("tbl"))
    return ops.memo_tables(tables, pages, filled).select(*PAGE, "tbl")


@query("blank_boxes", "C28", """
WITH b AS (SELECT *, y0 + 15 AS by1 FROM shapes WHERE flag = 'A'), f AS (SELECT *, x0 + 30 AS fx1, y0 + 10 AS fy1 FROM shapes WHERE flag <> 'A'),
z AS (SELECT b.doc_id, b.page, b.sid AS box, b.x0, b.x1, bool_or((f.x0 + fx1) / 2 > b.x0 AND (f.x0 + fx1) / 2 < b.x1 AND (f.y0 + fy1) / 2 > b.y0 AND (f.y0 + fy1) / 2 < by1) AS inside,
  bool_or(least(fy1, by1) - greatest(f.y0, b.y0) >= 5 AND (fx1 <= b.x0 + 1 OR f.x0 >= b.x1 - 1) AND least(abs(fx1 - b.x0), abs(f.x0 - b.x1)) < 40) AS beside FROM b JOIN f ON f.doc_id = b.doc_id AND f.page = b.page GROUP BY ALL)
SELECT doc_id, page, box, CAST(greatest(2, round_even((x1 - x0) / 10, 0)) AS BIGINT) AS n FROM z WHERE NOT inside AND beside""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    boxes = role(s, "A").select(*PAGE, F.col("sid").alias("box"), "x0", "y0", "x1", (F.col("y0") + 15).alias("y1"))
    frags = s.where("flag <> 'A'").select(*PAGE, F.col("sid").alias("fid"), "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(10.0).alias("size"))
    return ops.blank_boxes(boxes, frags).groupBy(*PAGE, "box").agg(F.count("*").alias("n"))


@query("images_classified", "C29", """
SELECT doc_id, page, sid, CASE WHEN cy <= 100 OR cy >= 700 OR (w >= 357 AND (y0 + h <= 101 OR y0 >= 699)) THEN 'banner' WHEN disc = 3 THEN 'pill'
  WHEN w BETWEEN 4 AND 16 AND h BETWEEN 4 AND 16 AND w / h BETWEEN 0.75 AND 1.33 THEN CASE WHEN disc = 5 THEN 'decoration' ELSE 'icon' END
  WHEN w < 4 OR h < 4 OR (h < 26 AND w / h > 4.5) OR (flag <> 'A' AND h < 26 AND w < 120) THEN 'decoration' ELSE 'content' END AS "class"
FROM (SELECT *, y0 + h / 2 AS cy FROM (SELECT *, qty * 3 AS w, 3.0::DOUBLE + part % 40 AS h FROM shapes))""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    h = F.lit(3.0) + F.col("part") % 40
    images = s.select(*PAGE, "sid", "x0", "y0", (F.col("x0") + F.col("qty") * 3).alias("x1"), (F.col("y0") + h).alias("y1"), F.lit(595.0).alias("width"), F.lit(100.0).alias("top"), F.lit(700.0).alias("bottom"),
                      (F.col("disc") == 3).alias("is_pill"), (F.col("disc") == 5).alias("is_blank"), (F.col("flag") == "A").alias("boxed"))
    return ops.classify_images(images).select(*PAGE, "sid", "class")


@query("pill_labels", "C30", """
WITH i AS (SELECT doc_id, page, sid AS img, supp % 3 AS digest, x0 * 1.0 AS x0, y0, x0 + 30 AS x1, y0 + 12 AS y1 FROM shapes WHERE flag = 'A'),
f AS (SELECT doc_id, page, sid AS fid, CASE WHEN status = 'O' THEN 'word' ELSE '3. x' END AS text, x0, y0 AS y0, x0 + 100 AS x1, y0 + 10 AS y1 FROM shapes WHERE flag <> 'A'),
j AS (SELECT i.doc_id, i.page, i.img, any_value(i.digest) AS digest, bool_or(band AND f_x1 <= ix0 + 1) AS lft, arg_min(fid, (f_x0, fid)) FILTER (band AND f_x0 - ix1 BETWEEN -1 AND 24) AS fid, arg_min(text, (f_x0, fid)) FILTER (band AND f_x0 - ix1 BETWEEN -1 AND 24) AS text
 FROM (SELECT i.*, i.x0 AS ix0, i.x1 AS ix1, f.fid, f.text, f.x0 AS f_x0, f.x1 AS f_x1, least(f.y1, i.y1) - greatest(f.y0, i.y0) > 5 AND ((f.x0 + f.x1) / 2 < 297.5) = ((i.x0 + i.x1) / 2 < 297.5) AS band
       FROM i JOIN f ON f.doc_id = i.doc_id AND f.page = i.page) i GROUP BY i.doc_id, i.page, i.img),
p AS (SELECT * FROM j WHERE fid IS NOT NULL AND NOT lft AND text = 'word'),
n AS (SELECT doc_id, digest, row_number() OVER (PARTITION BY doc_id ORDER BY min((page, img))) AS number FROM p GROUP BY doc_id, digest)
SELECT p.doc_id, p.page, p.img, p.fid, CAST(number AS INTEGER) AS number FROM p JOIN n ON n.doc_id = p.doc_id AND n.digest = p.digest""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    images = role(s, "A").select(*PAGE, F.col("sid").alias("img"), (F.col("supp") % 3).alias("digest"), "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 12).alias("y1"))
    frags = s.where("flag <> 'A'").select(*PAGE, F.col("sid").alias("fid"), F.when(F.col("status") == "O", "word").otherwise("3. x").alias("text"), "x0", "y0", (F.col("x0") + 100).alias("x1"), (F.col("y0") + 10).alias("y1"))
    return ops.pill_labels(images, frags, one_page(s).withColumn("split_x", F.lit(297.5))).select(*PAGE, "img", "fid", "number")


@query("chart_labels_absorbed", "C31")
def _(spark, folder):
    s = shapes(spark, folder)
    images = role(s, "A", "O").select(*PAGE, F.col("sid").alias("img"), "x0", "y0", "x1", (F.col("y1") + 40).alias("y1"))
    frags = s.where("flag <> 'A'").select(*PAGE, F.col("sid").alias("fid"), F.lit("abc").alias("text"), (F.col("supp") % 12 + 1).cast("int").alias("chars"), "x0", "y0", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(10.0).alias("size"))
    return ops.absorb_labels(images, frags)


@query("brackets_detected", "C32", """
WITH n AS (SELECT doc_id, page, sid AS lid, x0, y0, x0 + 30 AS x1, y0 + 10 AS y1 FROM shapes), l AS (SELECT n.* FROM n JOIN shapes s ON s.doc_id = n.doc_id AND s.page = n.page AND s.sid = n.lid WHERE flag = 'A'),
r AS (SELECT doc_id, page, x0 + 15 AS x, y0 - 30 AS y0, y0 + qty * 3 AS y1, disc FROM shapes WHERE flag = 'A'),
t AS (SELECT l.doc_id, l.page, l.lid, arg_min({'x': r.x, 'a': r.y0, 'b': r.y1}, (abs(r.x - (l.x0 + l.x1) / 2), r.x, r.y0, r.y1)) AS s FROM l JOIN r ON r.doc_id = l.doc_id AND r.page = l.page AND r.x BETWEEN l.x0 - 3 AND l.x1 + 3 AND r.y0 <= l.y0 AND r.y1 >= l.y1 GROUP BY ALL),
ab AS (SELECT l.doc_id, l.page, l.lid, arg_max({'x': r.x, 'a': r.y0, 'b': r.y1}, (r.y1, -abs(r.x - (l.x0 + l.x1) / 2))) FILTER (r.y1 <= l.y1 AND l.y0 - r.y1 <= 60) AS u,
  arg_min({'x': r.x, 'a': r.y0, 'b': r.y1}, (r.y0, abs(r.x - (l.x0 + l.x1) / 2))) FILTER (r.y0 >= l.y0 AND r.y0 - l.y1 <= 60) AS w FROM l JOIN r ON r.doc_id = l.doc_id AND r.page = l.page AND r.x BETWEEN l.x0 - 3 AND l.x1 + 3 GROUP BY ALL),
t2 AS (SELECT * FROM t UNION ALL SELECT doc_id, page, lid, {'x': (u.x + w.x) / 2, 'a': least(u.a, w.a), 'b': greatest(u.b, w.b)} FROM ab WHERE u IS NOT NULL AND w IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = ab.doc_id AND t.page = ab.page AND t.lid = ab.lid)),
k AS (SELECT doc_id, page, x, y0 FROM r WHERE disc > 3)
SELECT t.doc_id, t.page, t.lid AS bracket, n.lid FROM t2 t JOIN n ON n.doc_id = t.doc_id AND n.page = t.page AND n.lid <> t.lid AND n.x0 > t.s.x AND (n.y0 + n.y1) / 2 BETWEEN t.s.a - 3 AND t.s.b + 3
WHERE t.s.b - t.s.a >= 25 AND EXISTS (SELECT 1 FROM k WHERE k.doc_id = t.doc_id AND k.page = t.page AND abs(k.x - t.s.x) <= 2 AND (abs(k.y0 - t.s.a) <= 2 OR abs(k.y0 - t.s.b) <= 2))""", ("shapes",))
def _(spark, folder):
    # strokes start 30 points above their label and run through it when long enough; ends are ticked where the discount is high
    s = shapes(spark, folder)
    lines = s.select(*PAGE, F.col("sid").alias("lid"), F.lit(0).alias("col"), F.lit(10.0).alias("size"), "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 10).alias("y1"), "flag")
    marks = role(s, "A")
    runs = marks.select(*PAGE, (F.col("x0") + 15).alias("x"), (F.col("y0") - 30).alias("y0"), (F.col("y0") + F.col("qty") * 3).alias("y1"))
    ticks = marks.where("disc > 3").select(*PAGE, (F.col("x0") + 15).alias("x0"), (F.col("x0") + 25).alias("x1"), (F.col("y0") - 30).alias("y0"))
    labels = lines.where("flag = 'A'")
    return ops.detect_brackets(labels.drop("flag"), runs, ticks, lines.drop("flag")).select(*PAGE, "bracket", "lid")


@query("underlined_glyphs", "C33", """
WITH l AS (SELECT doc_id, page, col, row_no AS line, text, 36.0::DOUBLE + 270 * col AS lx, x0, x1, y1, size FROM layout_rows),
s AS (SELECT doc_id, page, line, lx + 5 * (line % 10) + 1 AS sx0, lx + 5 * (line % 10 + line % 7 + 2) + 1 AS sx1, y1 + 1 AS y FROM l WHERE line % 3 = 0),
g AS (SELECT doc_id, page, line, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS gno, lx FROM l),
o AS (SELECT g.*, lx + 5 * gno + 2.5 BETWEEN sx0 - 0.5 AND sx1 + 0.5 AS hit FROM g JOIN s ON s.doc_id = g.doc_id AND s.page = g.page AND s.line = g.line),
m AS (SELECT *, hit AND c <> ' ' AS u, count(*) FILTER (hit AND c <> ' ') OVER (PARTITION BY doc_id, page, line) AS n FROM o)
SELECT doc_id, page, line, count(*) FILTER (u OR (c = ' ' AND pu AND nu)) AS n FROM (SELECT *, lag(u) OVER w AS pu, lead(u) OVER w AS nu FROM m WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY gno)) GROUP BY doc_id, page, line HAVING count(*) FILTER (u OR (c = ' ' AND pu AND nu)) > 0""", ("layout_rows",))
def _(spark, folder):
    rows = corpus.layout_rows(spark, folder).withColumns({"line": F.col("row_no"), "lx": F.lit(36.0) + F.col("col") * 270})
    lines = rows.select(*PAGE, "line", "x0", "x1", "y0", "y1", "size")
    n = F.col("line") % 10
    segments = rows.where("line % 3 = 0").select(*PAGE, F.col("line").alias("seg"), (F.col("lx") + n * 5 + 1).alias("x0"), (F.col("lx") + (n + F.col("line") % 7 + 2) * 5 + 1).alias("x1"), (F.col("y1") + 1).alias("y0"))
    glyphs = rows.select(*PAGE, "line", "lx", F.posexplode(F.split("text", "")).alias("gno", "c")).select(
        *PAGE, "line", "gno", (F.col("c") == " ").alias("space"), (F.col("lx") + F.col("gno") * 5).alias("x0"), (F.col("lx") + F.col("gno") * 5 + 5).alias("x1"))
    return ops.underlines(lines, glyphs, segments).groupBy(*PAGE, "line").agg(F.count_if("underline").alias("n")).where("n > 0")


@query("highlighted_glyphs", "C34", """
SELECT g.doc_id, g.page, g.sid, coalesce(arg_max('#' || f.disc, f.sid), '') AS shade FROM (SELECT *, x0 + 5 AS cx, y0 + 5 AS cy FROM shapes WHERE flag <> 'A') g
LEFT JOIN (SELECT * FROM shapes WHERE flag = 'A') f ON f.doc_id = g.doc_id AND f.page = g.page AND cx BETWEEN f.x0 - 1 AND f.x1 + 1 AND cy BETWEEN f.y0 - 2 AND f.y0 + 17 GROUP BY g.doc_id, g.page, g.sid""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    glyphs = s.where("flag <> 'A'").select(*PAGE, F.col("sid").alias("gid"), "x0", "y0", (F.col("x0") + 10).alias("x1"), (F.col("y0") + 10).alias("y1"))
    fills = role(s, "A").select(*PAGE, F.col("sid").alias("draw_ord"), "x0", "y0", "x1", (F.col("y0") + 15).alias("y1"), F.concat(F.lit("#"), F.col("disc").cast("string")).alias("color"))
    return ops.highlights(glyphs, fills).select(*PAGE, F.col("gid").alias("sid"), F.coalesce("shade", F.lit("")).alias("shade"))


def struck(s):
    """Strokes, tables of two rows and boxes of a page, moved to heights 40 points apart so that many fall together."""
    y = F.floor(F.col("y0") / 40) * 40.0
    strokes = role(s, "R").select(*PAGE, F.col("sid").alias("seg"), "x0", (y + F.col("sid") % 3).alias("y0"), "x1", (y + F.col("sid") % 3).alias("y1"))
    cells = role(s, "A").select(*PAGE, F.col("sid").alias("tbl"), F.explode(F.array(F.lit(0.0), F.lit(40.0))).alias("down"), (F.col("x0") - 40).alias("x0"), (F.col("x1") + 40).alias("x1"), y.alias("y")).select(
        *PAGE, "tbl", "x0", (F.col("y") + F.col("down")).alias("y0"), "x1", (F.col("y") + F.col("down") + 40).alias("y1"))
    boxes = role(s, "N").select(*PAGE, "x0", y.alias("y0"), "x1", (y + 80).alias("y1"))
    return strokes, cells, boxes


@query("underline_candidates", "C33", """
WITH s AS (SELECT doc_id, page, sid, x0, x1, floor(y0 / 40) * 40 + sid % 3 AS y FROM shapes WHERE flag = 'R'),
r AS (SELECT doc_id, page, x0 - 40 AS a, x1 + 40 AS b, floor(y0 / 40) * 40 + unnest([0, 40, 80]) AS y FROM shapes WHERE flag = 'A'),
e AS (SELECT doc_id, page, x0 AS a, x1 AS b, floor(y0 / 40) * 40 + unnest([0, 80]) AS y FROM shapes WHERE flag = 'N')
SELECT doc_id, page, sid AS seg FROM s WHERE x1 - x0 < 180 AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND r.page = s.page AND abs(s.y - r.y) <= 1.5 AND s.x0 >= a - 2 AND s.x1 <= b + 2)
 AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = s.doc_id AND e.page = s.page AND abs(s.y - e.y) <= 1.5 AND ((s.x0 <= a + 3 AND s.x1 >= b - 3) OR s.x1 - s.x0 >= 0.8 * (b - a)))""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    strokes, cells, boxes = struck(s)
    pages = s.select(*PAGE).distinct().withColumn("width", F.lit(300.0))
    return ops.underline_strokes(strokes, pages, ops.table_rules(cells), ops.flat_edges(boxes)).select(*PAGE, "seg")


@query("label_blanks_underlined", "C33", """
WITH l AS (SELECT doc_id, ord, CASE number % 3 WHEN 0 THEN 'ab:' WHEN 1 THEN 'a label too long:' ELSE 'ab ：' END AS text, l_quantity AS q, l_discount AS d FROM numbers),
f AS (SELECT *, 50.0 + 5 * length(text) AS lx1, 50.0 + 5 * length(text) + q - 5 AS sx0, 15 + 100 * d + q AS len FROM l),
h AS (SELECT *, (SELECT count(*) FROM range(length(text)) r(k) WHERE 50.0 + 5 * k + 2.5 BETWEEN sx0 - 0.5 AND sx0 + len + 0.5 AND text[k + 1] <> ' ') AS solid FROM f)
SELECT doc_id, ord, CAST(length(text) + CASE WHEN behind THEN n + 1 ELSE 0 END AS BIGINT) AS glyphs, CAST(CASE WHEN solid > 0 THEN solid WHEN behind THEN n ELSE 0 END AS BIGINT) AS underlined,
       CASE WHEN behind THEN sx0 + n * 5 ELSE lx1 END AS ends
FROM (SELECT *, solid = 0 AND lx1 - 1 <= sx0 AND sx0 - lx1 < 40 AND len > 20 AND length(text) <= 12 AS behind, CAST(greatest(3, round_even(len / 5, 0)) AS INTEGER) AS n FROM h)""", ("numbers",))
def _(spark, folder):
    # dealt by document before they grow into glyphs, which then meet their line and its strokes there
    n = corpus.numbers(spark, folder).repartition(corpus.pieces(spark, folder, "lineitem", 1 << 20), "doc_id")
    text = F.when(F.col("number") % 3 == 0, "ab:").when(F.col("number") % 3 == 1, "a label too long:").otherwise("ab ：")
    rows = n.select("doc_id", F.lit(1).alias("page"), F.col("ord").alias("line"), text.alias("text"), "l_quantity", "l_discount").withColumn("y1", F.lit(100.0) + F.col("line") * 20)
    end = F.lit(50.0) + F.length("text") * 5
    lines = rows.select(*PAGE, "line", "text", F.lit(10.0).alias("size"), F.lit(50.0).alias("x0"), (F.col("y1") - 10).alias("y0"), end.alias("x1"), "y1")
    start = end + F.col("l_quantity") - 5
    segments = rows.select(*PAGE, F.col("line").alias("seg"), start.alias("x0"), (F.col("y1") + 1).alias("y0"), (start + 15 + 100 * F.col("l_discount") + F.col("l_quantity")).alias("x1"))
    glyphs = rows.select(*PAGE, "line", F.posexplode(F.split("text", "")).alias("gno", "c")).select(
        *PAGE, "line", "gno", (F.col("c") == " ").alias("space"), (F.lit(50.0) + F.col("gno") * 5).alias("x0"), (F.lit(55.0) + F.col("gno") * 5).alias("x1"))
    out = ops.underlines(lines, glyphs, segments)
    return out.groupBy("doc_id", F.col("line").alias("ord")).agg(F.count("*").alias("glyphs"), F.count_if("underline").alias("underlined"), F.max("x1").alias("ends"))


@query("highlighted_outside_tables", "C34", """
WITH g AS (SELECT *, x0 + 5 AS cx, y0 + 5 AS cy, y0 - part % 3 * 4 AS ly0, y0 - part % 3 * 4 + 10 AS ly1 FROM shapes WHERE flag <> 'A'),
f AS (SELECT * FROM shapes b WHERE flag = 'A' AND NOT EXISTS (SELECT 1 FROM shapes t WHERE t.doc_id = b.doc_id AND t.page = b.page AND t.flag = 'N' AND b.x0 >= t.x0 - 102 AND b.x1 <= t.x1 + 102 AND b.y0 >= t.y0 - 62 AND b.y0 + 15 <= t.y1 + 62))
SELECT g.doc_id, g.page, g.sid, coalesce(arg_max('#' || f.disc, f.sid), '') AS shade FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.page = g.page AND g.supp % 4 <> 0
 AND cx BETWEEN f.x0 - 1 AND f.x1 + 1 AND cy BETWEEN f.y0 - 2 AND f.y0 + 17 AND ly0 < f.y0 + 15 AND ly1 > f.y0 GROUP BY g.doc_id, g.page, g.sid""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    above = F.col("y0") - F.col("part") % 3 * 4
    glyphs = s.where("flag <> 'A'").select(*PAGE, F.col("sid").alias("gid"), "x0", "y0", (F.col("x0") + 10).alias("x1"), (F.col("y0") + 10).alias("y1"),
                                           (F.col("supp") % 4 == 0).alias("in_cell"), above.alias("line_y0"), (above + 10).alias("line_y1"))
    fills = role(s, "A").select(*PAGE, F.col("sid").alias("draw_ord"), "x0", "y0", "x1", (F.col("y0") + 15).alias("y1"), F.concat(F.lit("#"), F.col("disc").cast("string")).alias("color"))
    tables = role(s, "N").select(*PAGE, (F.col("x0") - 100).alias("x0"), (F.col("y0") - 60).alias("y0"), (F.col("x1") + 100).alias("x1"), (F.col("y1") + 60).alias("y1"))
    return ops.highlights(glyphs, fills, tables).select(*PAGE, F.col("gid").alias("sid"), F.coalesce("shade", F.lit("")).alias("shade"))


def pictures_and_texts(s):
    """Pictures, and texts around them; a third of the texts opens with '<' and a third closes with '>'."""
    images = role(s, "A").select(*PAGE, F.col("sid").alias("img"), "x0", "y0", (F.col("x0") + 60 + F.col("qty") * 4).alias("x1"), (F.col("y0") + 60 + F.col("part") % 60).alias("y1"))
    foot = F.lit(60.0) + F.floor(F.col("y0") / 5) * 5
    text = F.concat(F.when(F.col("part") % 3 != 1, "< ").otherwise(""), F.lit("w"), F.col("sid").cast("string"), F.when(F.col("part") % 3 != 2, ">").otherwise(""))
    frags = s.where("flag <> 'A'").select(*PAGE, F.col("sid").alias("fid"), text.alias("text"), (F.lit(8.0) + F.col("supp") % 3 * 8).alias("size"), "x0", foot.alias("y0"), (F.col("x0") + 20 + F.col("qty")).alias("x1"), (foot + 10).alias("y1"))
    return images, frags


PICTURES = """
WITH i AS (SELECT doc_id, page, sid AS img, x0, y0, x0 + 60 + qty * 4 AS x1, y0 + 60 + part % 60 AS y1 FROM shapes WHERE flag = 'A'),
f AS (SELECT doc_id, page, sid AS fid, CASE WHEN part % 3 <> 1 THEN '<' ELSE '' END || 'w' || sid || CASE WHEN part % 3 <> 2 THEN '>' ELSE '' END AS t, 8.0 + supp % 3 * 8 AS size, x0, 60.0 + floor(y0 / 5) * 5 AS y0, x0 + 20 + qty AS x1, 70.0 + floor(y0 / 5) * 5 AS y1
      FROM shapes WHERE flag <> 'A')"""


@query("captions_absorbed", "C31", PICTURES + """,
b AS (SELECT i.doc_id, i.page, img, list(fid) AS fids, string_agg(t, '' ORDER BY f.x0, fid) AS read FROM i JOIN f ON f.doc_id = i.doc_id AND f.page = i.page AND f.y0 - i.y1 BETWEEN 0 AND 1.5 * size AND i.x0 - size <= f.x0 AND f.x1 <= i.x1 + size GROUP BY ALL)
SELECT doc_id, page, frag, min(img) AS image FROM (SELECT doc_id, page, img, unnest(fids) AS frag FROM b WHERE regexp_full_match(read, '[<〈＜].{1,30}[>〉＞]')) GROUP BY ALL""", ("shapes",))
def _(spark, folder):
    return ops.captions(*pictures_and_texts(shapes(spark, folder)))


@query("bubble_texts_absorbed", "C31", PICTURES + """,
p AS (SELECT i.doc_id, i.page, img, fid, f.x0 AS a, f.x1 AS b, i.x0 AS ia, i.x1 AS ib FROM i JOIN f ON f.doc_id = i.doc_id AND f.page = i.page AND i.x1 - i.x0 >= 80 AND i.y1 - i.y0 >= 80
      AND f.x0 >= i.x0 - 1 AND f.x1 <= i.x1 + 1 AND f.y0 >= i.y0 - 1 AND f.y1 <= i.y1 + 1),
g AS (SELECT doc_id, page, img FROM p GROUP BY doc_id, page, img, ia, ib HAVING count(*) >= 2 AND max(b - a) <= 0.8 * (ib - ia) AND (min(a) - ia >= 0.2 * (ib - ia) OR ib - max(b) >= 0.2 * (ib - ia)))
SELECT doc_id, page, fid AS frag, min(img) AS image FROM p JOIN g USING (doc_id, page, img) GROUP BY ALL""", ("shapes",))
def _(spark, folder):
    return ops.bubble_texts(*pictures_and_texts(shapes(spark, folder)))


ASSIGN = """
SELECT doc_id, page, sid, kind, CASE WHEN kind = 'table' AND NOT m.a > sa * 1.02 THEN NULL WHEN kind = 'image' AND NOT (x0 >= m.x0 - 3 AND x1 <= m.x1 + 3) THEN NULL ELSE m.box END AS box FROM (
 SELECT i.doc_id, i.page, i.sid, i.kind, i.x0, i.x1, (i.x1 - i.x0) * (i.y1 - i.y0) AS sa, arg_min({'a': b.a, 'box': b.box, 'x0': b.x0, 'x1': b.x1}, (b.a, b.box)) AS m
 FROM (SELECT *, CASE WHEN status = 'O' THEN 'line' WHEN qty > 25 THEN 'table' ELSE 'image' END AS kind FROM shapes WHERE flag = 'R') i
 LEFT JOIN big_boxes b ON b.doc_id = i.doc_id AND b.page = i.page AND (i.y0 + i.y1) / 2 BETWEEN b.y0 - 2 AND b.y1 + 2
  AND CASE WHEN kind = 'line' THEN i.x0 >= b.x0 - 4 AND i.x1 <= b.x1 + 4 ELSE (i.x0 + i.x1) / 2 BETWEEN b.x0 - 2 AND b.x1 + 2 END GROUP BY ALL)"""


def boxed_items(s):
    items = role(s, "R").select(*PAGE, F.col("sid").alias("iid"), F.when(F.col("status") == "O", "line").when(F.col("qty") > 25, "table").otherwise("image").alias("kind"), "x0", "y0", "x1", "y1")
    return ops.assign_boxes(items, big_boxes(s).select(*PAGE, "box", "x0", "y0", "x1", "y1"))


@query("items_in_boxes", "C35", f"SELECT doc_id, page, sid, coalesce(box, 0) AS box FROM ({ASSIGN})", ("big_boxes",))
def _(spark, folder):
    return boxed_items(shapes(spark, folder)).select(*PAGE, F.col("iid").alias("sid"), F.coalesce("box", F.lit(0)).alias("box"))


@query("word_boxes", "C35", f"""
SELECT b.doc_id, b.page, b.box FROM big_boxes b LEFT JOIN (SELECT doc_id, page, box, count(*) AS n, bool_and(kind = 'line') AS lines FROM ({ASSIGN}) WHERE box IS NOT NULL GROUP BY ALL) i ON i.doc_id = b.doc_id AND i.page = b.page AND i.box = b.box
WHERE b.y1 - b.y0 < 18 AND (n IS NULL OR (b.qty > 20 AND n = 1 AND lines))""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    boxes = big_boxes(s).withColumn("fill", F.when(F.col("qty") > 20, "#FFFF00"))
    return ops.word_boxes(boxes, boxed_items(s))


@query("inner_drawings", "C36", """
SELECT b.doc_id, b.page, b.box, CAST(coalesce(v.n, 0) + coalesce(o.n, 0) + 4 * coalesce(k.n, 0) AS BIGINT) AS drawings FROM big_boxes b
LEFT JOIN (SELECT b.doc_id, b.page, b.box, count(*) AS n FROM big_boxes b JOIN shapes s ON s.doc_id = b.doc_id AND s.page = b.page AND s.flag = 'R' AND s.x0 > b.x0 + 3 AND s.x0 < b.x1 - 3 AND s.y0 >= b.y0 - 1 AND s.y1 <= b.y1 + 1 GROUP BY ALL) v ON v.doc_id = b.doc_id AND v.page = b.page AND v.box = b.box
LEFT JOIN (SELECT b.doc_id, b.page, b.box, count(*) AS n FROM big_boxes b JOIN shapes s ON s.doc_id = b.doc_id AND s.page = b.page AND s.flag = 'N' AND s.x0 > b.x0 + 2 AND s.x1 < b.x1 - 2 AND s.y0 > b.y0 + 2 AND s.y1 < b.y1 - 2
   AND greatest(s.x0 - b.x0, s.y0 - b.y0, b.x1 - s.x1, b.y1 - s.y1) > 12 GROUP BY ALL) o ON o.doc_id = b.doc_id AND o.page = b.page AND o.box = b.box
LEFT JOIN (SELECT b.doc_id, b.page, b.box, count(*) AS n FROM big_boxes b JOIN shapes s ON s.doc_id = b.doc_id AND s.page = b.page AND s.status = 'O' AND s.x0 >= b.x0 - 1 AND s.x1 <= b.x1 + 1 AND s.y0 >= b.y0 - 1 AND s.y1 <= b.y1 + 1 GROUP BY ALL) k ON k.doc_id = b.doc_id AND k.page = b.page AND k.box = b.box""", ("big_boxes",))
def _(spark, folder):
    s = shapes(spark, folder)
    strokes = role(s, "R").withColumn("x1", F.col("x0"))
    return ops.inner_drawings(big_boxes(s), strokes, role(s, "N"), s.where("status = 'O'")).select(*PAGE, "box", "drawings")


@query("line_frames", "C36", """
WITH r AS (SELECT doc_id, page, sid AS rid, x0 // 1 * 1.0 AS x0, y0, x0 + 60 AS x1, y0 + 20 AS y1 FROM shapes WHERE flag <> 'R'), l AS (SELECT doc_id, page, sid AS lid, x0, y0, x0 + 40 AS x1, y0 + 10 AS y1 FROM shapes WHERE flag = 'R'),
a AS (SELECT r.doc_id, r.page, r.rid, count(*) AS n, any_value(lid) AS lid, any_value(60 >= 0.7 * 40) AS fits FROM r JOIN l ON l.doc_id = r.doc_id AND l.page = r.page AND (l.x0 + l.x1) / 2 BETWEEN r.x0 - 1 AND r.x1 + 1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 1 AND r.y1 + 1 GROUP BY r.doc_id, r.page, r.rid HAVING count(*) = 1),
t AS (SELECT DISTINCT p.doc_id, p.page, p.rid FROM r p JOIN r q ON q.doc_id = p.doc_id AND q.page = p.page AND q.rid <> p.rid AND abs(p.x0 - q.x0) < 3 AND abs(p.y0 - q.y0) < 3)
SELECT a.doc_id, a.page, a.lid, CASE WHEN bool_or(t.rid IS NOT NULL) THEN 'DOUBLE_SLIM' ELSE 'SOLID' END AS frame FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t.page = a.page AND t.rid = a.rid GROUP BY a.doc_id, a.page, a.lid""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    frames = s.where("flag <> 'R'").select(*PAGE, F.col("sid").alias("rid"), "x0", "y0", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 20).alias("y1"))
    lines = role(s, "R").select(*PAGE, F.col("sid").alias("lid"), "x0", "y0", (F.col("x0") + 40).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(10.0).alias("size"))
    return ops.line_frames(frames, lines)


@query("white_text", "C37", """
SELECT g.doc_id, g.page, g.sid, CASE WHEN g.disc < 4 AND NOT EXISTS (SELECT 1 FROM shapes b WHERE b.doc_id = g.doc_id AND b.page = g.page AND b.flag = 'A' AND b.sid = g.sid - 1 AND b.qty < 25) THEN '' WHEN g.disc < 4 THEN '#FFFFFF' ELSE '#102030' END AS color FROM shapes g""", ("shapes",))
def _(spark, folder):
    s = shapes(spark, folder)
    glyphs = s.select(*PAGE, "sid", (F.col("sid") - 1).alias("box"), F.when(F.col("disc") < 4, "#FFFFFF").otherwise("#102030").alias("color"))
    boxes = role(s, "A").select(*PAGE, F.col("sid").alias("box"), F.when(F.col("qty") < 25, "#202020").otherwise("#EEEEEE").alias("fill"))
    return ops.white_text(glyphs, boxes).select(*PAGE, "sid", F.coalesce("color", F.lit("")).alias("color"))


@query("notices_dropped", "C38", """
WITH l AS (SELECT *, l_quantity > 45 AS seed FROM numbers)
SELECT l.doc_id, l.ord FROM l WHERE EXISTS (SELECT 1 FROM l s WHERE s.doc_id = l.doc_id AND s.number = l.number AND s.seed)""", ("numbers",))
def _(spark, folder):
    # lines of one number touch, other numbers stand apart
    n = corpus.numbers(spark, folder)
    y = F.col("ord") * 14.0 + F.col("number") * 30
    items = n.select("doc_id", F.lit(1).alias("page"), F.col("ord").cast("long").alias("iid"), F.lit("line").alias("kind"), F.when(F.col("l_quantity") > 45, "제작 연월일").otherwise("x").alias("text"),
                     F.lit(None).cast("int").alias("box"), F.lit(36.0).alias("x0"), y.alias("y0"), F.lit(136.0).alias("x1"), (y + 10).alias("y1"))
    rules = n.where("ord < 0").select("doc_id", F.lit(1).alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"))
    return ops.drop_notice(items, rules).select("doc_id", F.col("iid").cast("int").alias("ord"))


@query("outline_letter_rows", "C44", """
SELECT doc_id, min(x0) AS x0, max(x1) AS x1, CAST(count(*) AS INTEGER) AS letters FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY x0) AS row FROM (
 SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0) <= 15 THEN 0 ELSE 1 END AS n FROM (SELECT doc_id, ord * 60.0::DOUBLE AS x0, ord * 60.0::DOUBLE + 12 + l_quantity AS x1 FROM numbers))) GROUP BY doc_id, row""", ("numbers",))
def _(spark, folder):
    x0 = F.col("ord") * 60.0
    paths = corpus.numbers(spark, folder).select("doc_id", F.lit(1).alias("page"), x0.alias("x0"), F.lit(100.0).alias("y0"), (x0 + 12 + F.col("l_quantity")).alias("x1"), F.lit(110.0).alias("y1"))
    return ops.outline_rows(paths).select("doc_id", "x0", "x1", "letters")


@query("bracket_labels_split", "C32", """
WITH l AS (SELECT doc_id, ord, CASE number % 4 WHEN 0 THEN '[A] of text' WHEN 1 THEN '[A]' WHEN 2 THEN 'text [A]' ELSE ' [B]text' END AS text, number % 4 AS kind, 50.0 + l_quantity % 40 AS x, l_discount * 100 AS d, l_suppkey % 7 = 0 AS cell,
            100.0 + ord * 100 AS y0, CASE WHEN l_partkey % 3 = 0 THEN 12.0 ELSE 30.0 END AS len, l_partkey % 2 = 0 AS above FROM numbers),
r AS (SELECT *, CASE WHEN above THEN y0 + 5 + d * 3 - len ELSE y0 + 12 - d * 3 END AS ra, CASE WHEN above THEN y0 + 5 + d * 3 ELSE y0 + 12 - d * 3 + len END AS rb FROM l),
s AS (SELECT doc_id, ord, text, kind IN (0, 3) AND NOT cell AND rb - ra >= 20 AND (rb <= y0 + 20 OR ra >= y0 - 10) AND x BETWEEN CASE kind WHEN 3 THEN 55 ELSE 50 END - 3 AND CASE kind WHEN 3 THEN 70 ELSE 65 END + 3 AND x < 70 AS split FROM r)
SELECT doc_id, ord, part, string_agg(c, '' ORDER BY k) AS text FROM (
 SELECT doc_id, ord, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS k, text, split,
        CASE WHEN split THEN CASE WHEN unnest(range(length(text))) < instr(text, ']') THEN 'label' ELSE 'body' END ELSE 'line' END AS part FROM s)
WHERE NOT split OR c <> ' ' OR k > instr(text, ']') GROUP BY ALL""".replace("WHERE NOT split OR c <> ' ' OR k > instr(text, ']') GROUP BY ALL", "WHERE NOT split OR c <> ' ' OR k > instr(text, ']') GROUP BY doc_id, ord, part"), ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder).repartition(corpus.pieces(spark, folder, "lineitem", 1 << 20), "doc_id")
    kind = F.col("number") % 4
    text = F.when(kind == 0, "[A] of text").when(kind == 1, "[A]").when(kind == 2, "text [A]").otherwise(" [B]text")
    y0, drop = F.lit(100.0) + F.col("ord") * 100, F.col("l_discount") * 100 * 3
    length, above = F.when(F.col("l_partkey") % 3 == 0, 12.0).otherwise(30.0), F.col("l_partkey") % 2 == 0
    rows = n.select("doc_id", F.lit(1).alias("page"), F.col("ord").alias("line"), text.alias("text"), F.lit(10.0).alias("size"), y0.alias("y0"), (y0 + 10).alias("y1"), (F.col("l_suppkey") % 7 == 0).alias("in_cell"),
                    (F.lit(50.0) + F.col("l_quantity") % 40).alias("x"), F.when(above, y0 + 5 + drop - length).otherwise(y0 + 12 - drop).alias("ra"), F.when(above, y0 + 5 + drop).otherwise(y0 + 12 - drop + length).alias("rb"))
    glyphs = rows.select(*PAGE, "line", F.posexplode(F.split("text", "")).alias("gno", "c"))
    glyphs = glyphs.withColumns({"x0": F.lit(50.0) + F.col("gno") * 5, "x1": F.lit(55.0) + F.col("gno") * 5})
    runs = rows.select(*PAGE, "x", F.col("ra").alias("y0"), F.col("rb").alias("y1"))
    out = ops.split_labels(rows.select(*PAGE, "line", "text", "size", "y0", "y1", "in_cell"), glyphs, runs).withColumn("part", F.coalesce("part", F.lit("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gno", "c"))), lambda g: g["c"]), "")
    return out.groupBy("doc_id", F.col("line").alias("ord"), "part").agg(joined.alias("text"))


@query("outline_rows_kept", "C44", """
WITH RECURSIVE r AS (SELECT doc_id, ord, 50.0 + l_partkey % 200 AS x0, 50.0 + l_partkey % 200 + 20 + l_quantity AS x1, 100.0 + ord * 14 AS y0, number % 4 + 1 AS n, l_discount >= 0.07 AS twice, l_suppkey % 4 = 0 AS followed, l_partkey % 2 = 0 AS large FROM numbers),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0) AS k, n >= 3 OR (n <= 2 AND followed AND NOT large) AS root FROM r WHERE NOT twice),
w AS (
 SELECT doc_id, k, ord, CASE WHEN root THEN [{'x0': x0, 'x1': x1, 'y1': y0 + 10}] ELSE [] END AS kept, root AS keep FROM f WHERE k = 1
 UNION ALL
 SELECT f.doc_id, f.k, f.ord, CASE WHEN ok THEN list_append(w.kept, {'x0': f.x0, 'x1': f.x1, 'y1': f.y0 + 10}) ELSE w.kept END, ok
 FROM w JOIN f ON f.doc_id = w.doc_id AND f.k = w.k + 1, LATERAL (SELECT f.root OR len(list_filter(w.kept, lambda q: f.y0 - q.y1 BETWEEN 0 AND 18 AND f.x0 BETWEEN q.x0 - 20 AND q.x1)) > 0 AS ok))
SELECT r.doc_id, CAST(n AS INTEGER) AS letters, x0 - 3 AS x0, y0 - 1.5 AS y0, x1 + 5 AS x1, y0 + 11.5 AS y1 FROM r JOIN w ON w.doc_id = r.doc_id AND w.ord = r.ord WHERE keep""", ("numbers",))
def _(spark, folder):
    n = corpus.numbers(spark, folder)
    x0, y0 = F.lit(50.0) + F.col("l_partkey") % 200, F.lit(100.0) + F.col("ord") * 14
    rows = n.select("doc_id", F.lit(1).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity")).alias("x1"), (y0 + 10).alias("y1"), (F.col("number") % 4 + 1).cast("int").alias("letters"),
                    (F.col("l_discount") >= 0.07).alias("twice"), (F.col("l_suppkey") % 4 == 0).alias("followed"), (F.col("l_partkey") % 2 == 0).alias("large"))
    over = rows.where("twice").select(*PAGE, F.lit("g").alias("c"), F.lit(10.0).alias("size"), "x0", "y0", (F.col("x0") + 0.6 * (F.col("x1") - F.col("x0"))).alias("x1"), "y1")
    behind = rows.where("followed").select(*PAGE, F.lit("g").alias("c"), F.when(F.col("large"), 12.0).otherwise(10.0).alias("size"), (F.col("x1") + 10).alias("x0"), "y0", (F.col("x1") + 15).alias("x1"), "y1")
    return ops.kept_outline_rows(rows.select(*PAGE, "x0", "y0", "x1", "y1", "letters"), over.unionByName(behind)).drop("page")
