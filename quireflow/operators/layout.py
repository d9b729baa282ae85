"""Lines, columns and reading order out of glyphs and text fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.conventions import CIRCLED, EM_SPACE, KOREAN, SPACE, Conventions
from quireflow.functions import scan
from quireflow.functions import text as tx

FRAG = ["doc_id", "page", "frag"]


def frags(glyphs: DataFrame) -> DataFrame:
    """Bounds, median size and text of fragments; white space does not count, all-space fragments go.

    Glyphs are counted by size first; a fragment has few sizes, and the median looks at these with their counts.
    """
    sizes = glyphs.where(~tx.is_space(F.col("c"))).groupBy(*FRAG, "size").agg(
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.count("*").alias("n"))
    return sizes.groupBy(*FRAG).agg(
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
        F.percentile("size", F.lit(0.5), F.col("n")).alias("size"), F.sum("n").alias("glyphs"))


def plain_strokes(glyphs: DataFrame) -> DataFrame:
    """Takes back bold from fonts that stroke nearly every glyph (85 % of 50 or more).

    Fonts are counted by page first, and only these counts are dealt by font: they go back to their pages, so that glyphs dealt
    by page stay there. A page has few fonts, so its counts are held while its glyphs pass.
    """
    stroked = (F.col("char_flags").bitwiseAND(48) == 48) & (F.col("c") != " ")
    fonts = glyphs.groupBy("doc_id", "page", "font").agg(F.count_if(F.col("c") != " ").alias("n"), F.count_if(stroked).alias("s"))
    font = Window.partitionBy("doc_id", "font")
    fonts = fonts.withColumns({"__n": F.sum("n").over(font), "__s": F.sum("s").over(font)})
    plain = fonts.where((F.col("__n") >= 50) & (F.col("__s") >= 0.85 * F.col("__n"))).select("doc_id", "page", "font", F.lit(True).alias("__plain"))
    only_stroke = stroked & ~tx.is_bold(F.col("font"), F.col("flags"), F.lit(0))
    out = glyphs.join(plain.hint("shuffle_hash"), ["doc_id", "page", "font"], "left")
    return out.withColumn("bold", F.col("bold") & ~(F.coalesce("__plain", F.lit(False)) & only_stroke)).drop("__plain")


def merge_boxed(glyphs: DataFrame) -> DataFrame:
    """A glyph printed alone inside a square sign becomes that glyph, boxed, with the square's bounds.

    `glyphs` has doc_id, page, gid, c, x0, y0, x1, y1, size. Squares are rare, so they are the small side of the range join,
    whose equality keys are the page.
    """
    squares = glyphs.where("c = '□'").select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("gid", "x0", "y0", "x1", "y1", "size")])
    inside = ((F.col("x0") >= F.col("b_x0") - 0.5) & (F.col("x1") <= F.col("b_x1") + 0.5)
              & (F.col("y0") >= F.col("b_y0") - 0.5) & (F.col("y1") <= F.col("b_y1") + 0.5))
    near = glyphs.join(squares, ["doc_id", "page"]).where(inside & (F.col("gid") != F.col("b_gid")) & (tx.strip("c") != ""))
    alone = near.groupBy("doc_id", "page", "b_gid").agg(F.count("*").alias("n"), F.min("gid").alias("gid"), *[
        F.first(f"b_{c}").alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1", "size")]).where("n = 1")
    letters = alone.groupBy("doc_id", "page", "gid").agg(F.max_by(F.struct(*[f"b_{c}" for c in ("x0", "y0", "x1", "y1", "size")]), "b_gid").alias("b"))
    out = glyphs.join(alone.select("doc_id", "page", F.col("b_gid").alias("gid")), ["doc_id", "page", "gid"], "left_anti").join(
        letters, ["doc_id", "page", "gid"], "left")
    blank = out.join(alone.select("doc_id", "page", *[F.col(f"b_{c}").alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")]), ["doc_id", "page"]).where(
        (tx.strip("c") == "") & (F.col("x0") >= F.col("s_x0")) & (F.col("x0") < F.col("s_x1"))
        & ((F.col("y0") + F.col("y1")) / 2).between(F.col("s_y0"), F.col("s_y1")))
    out = out.join(blank.select("doc_id", "page", "gid"), ["doc_id", "page", "gid"], "left_anti")
    return out.select("doc_id", "page", "gid", "c", *[F.coalesce(f"b.b_{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1", "size")],
                      F.col("b").isNotNull().alias("boxed"))


def drop_repeated(frags: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops header and footer fragments; returns the kept ones and the texts found outside the content band.

    `frags` has doc_id, page, text, y0, y1, size; `pages` has doc_id, page, height, top, bottom. A fragment in the upper or
    lower 12 % repeats if its text (digits alike) stands at the same height on enough pages. Counts combine before the
    shuffle, and only repeated keys are joined back.
    """
    key = [tx.norm_repeat("text").alias("key"), F.rint(F.col("y0") / 3).cast("int").alias("row")]
    rows = frags.join(pages, ["doc_id", "page"]).select("*", *key)
    outer = (F.col("y1") <= 0.12 * F.col("height")) | (F.col("y0") >= 0.88 * F.col("height"))
    cy = (F.col("y0") + F.col("y1")) / 2
    banded = (cy <= F.col("top")) | (cy >= F.col("bottom"))
    sizes = pages.groupBy("doc_id").agg(F.greatest(F.lit(2), F.floor(F.count("*") * 0.4)).alias("need"))
    word = F.regexp_replace("key", r"[#]|[^\p{L}\p{N}_]", "")
    counts = rows.where(outer).groupBy("doc_id", "key", "row").agg(F.count("*").alias("n"))
    repeated = counts.join(sizes, "doc_id").where((F.col("n") >= F.col("need")) & (F.length(word) >= 3) & ~F.col("key").startswith("※")).select(
        "doc_id", "key", "row", F.lit(True).alias("__rep"))
    marked = rows.join(repeated, ["doc_id", "key", "row"], "left")
    number = tx.rx(tx.strip("text"), rf"^-{SPACE}*\p{{Nd}}+{SPACE}*-$")
    dropped = outer & (F.coalesce("__rep", F.lit(False)) | number)
    kept = marked.where(~banded & ~dropped).select(*frags.columns)
    texts = rows.where(banded & (tx.strip("text") != "")).select("doc_id", "page", tx.strip("text").alias("text"), "size", "y0")
    return kept, texts


def group_lines(frags: DataFrame, area: list[str]) -> DataFrame:
    """Numbers text lines: in order of height a fragment joins the most recent of the last four lines whose first fragment
    overlaps it by half of the smaller height.

    Where no fragment reaches over a horizontal cut, nothing below can join a line above, so the page column is first cut
    there; the order-dependent rule is folded inside a band, which is usually one text line.
    `frags` has area keys + (fid, x0, y0, x1, y1). A fragment's other columns go with it through the fold. The lowest start
    below is a running minimum from the foot of the column up: a frame from each row to the last would be read anew for each row.
    """
    order = Window.partitionBy(*area).orderBy("cy", "x0", "fid")
    upwards = Window.partitionBy(*area).orderBy(F.desc("cy"), F.desc("x0"), F.desc("fid"))
    rows = frags.withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    above = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    below = F.min("y0").over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__below", below).withColumn("__above", above)
    rows = rows.withColumn("__cut", F.coalesce(F.col("__below") >= F.col("__above"), F.lit(True)).cast("int"))
    rows = rows.withColumn("__band", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = [c for c in frags.columns if c not in (*area, "x0", "fid", "y0", "y1")]
    bands = rows.groupBy(*area, "__band").agg(F.array_sort(F.collect_list(F.struct("cy", "x0", "fid", "y0", "y1", F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest")))).alias("f"))

    def fits(h: Column, f: Column) -> Column:
        return F.least(h["y1"], f["y1"]) - F.greatest(h["y0"], f["y0"]) >= 0.5 * F.least(f["y1"] - f["y0"], h["y1"] - h["y0"])

    def advance(state: Column, f: Column) -> Column:
        recent = F.slice(state["heads"], F.greatest(F.lit(1), F.size(state["heads"]) - 3), 4)
        fitting = F.filter(recent, lambda h: fits(h, f))
        line = F.when(F.size(fitting) > 0, F.try_element_at(fitting, F.lit(-1))["no"]).otherwise(F.size(state["heads"]))
        heads = F.when(F.size(fitting) > 0, state["heads"]).otherwise(
            F.concat(state["heads"], F.array(F.struct(F.size(state["heads"]).alias("no"), f["y0"].alias("y0"), f["y1"].alias("y1")))))
        return F.struct(heads.alias("heads"), F.concat(state["out"], F.array(line)).alias("out"))

    begin = F.struct(F.array().cast("array<struct<no:int,y0:double,y1:double>>").alias("heads"), F.array().cast("array<int>").alias("out"))
    # where all fit the first fragment they are its line, and nothing is folded
    first = F.element_at("f", 1)
    level = F.forall("f", lambda f: F.coalesce(fits(first, f), F.lit(False)))
    nos = F.when((F.size("f") == 1) | level, F.array_repeat(F.lit(0), F.size("f"))).otherwise(F.aggregate("f", begin, advance)["out"])
    lines = bands.select(*area, "__band", F.inline(F.arrays_zip("f", nos.alias("no"))))
    numbered = lines.withColumn("line", F.dense_rank().over(Window.partitionBy(*area).orderBy("__band", "no")))
    return numbered.select(*[c if c in area else F.col(f"f.rest.{c}" if c in rest else f"f.{c}").alias(c) for c in frags.columns], "line")


def split_far(frags: DataFrame, line: list[str], conventions: Conventions = KOREAN) -> DataFrame:
    """Parts fragments of one height that stand far apart; short pieces spread over a row stay together.

    `frags` has line keys + (fid, text, x0, x1, size, icon). Gaps are measured from the furthest right end of the piece,
    which is a running maximum: a fragment that opens a piece lies right of all ends before it.
    """
    order = Window.partitionBy(*line).orderBy("x0", "fid")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("icon") | tx.rx(F.col("text"), rf"^{SPACE}*[{CIRCLED}]")
    label = tx.rx(F.col("text"), conventions.side_label)
    rows = frags.withColumns({"__starts": starts, "__label": label})
    rows = rows.withColumns({
        "gap": F.col("x0") - F.max("x1").over(upto), "__p_size": F.lag("size").over(order), "__p_label": F.lag("__label").over(order),
        "__choices": F.first("__starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    cut = ((F.col("__label") | F.col("__p_label")) & (F.col("gap") > 0.8 * F.col("size"))) | (
        (F.col("gap") > 3.0 * F.greatest("size", "__p_size")) & ~F.col("__starts") & ~F.col("__choices"))
    rows = rows.withColumn("__cut", F.coalesce(cut, F.lit(False)).cast("int"))
    rows = rows.withColumn("piece", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a line's fragments are brought together once, looked at and parted again: nothing is joined back
    rest = [c for c in frags.columns if c not in line]
    lists = rows.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("x0", "fid", "piece", "text", "__label", F.struct(*rest).alias("own")))).alias("f"))
    last = F.element_at("f", -1)["piece"]
    texts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: tx.strip(F.array_join(F.filter("f", lambda f: f["piece"] == k)["text"], "")))
    short = F.forall(texts, lambda t: (F.length(t) <= F.when(last > 1, 12).otherwise(6)) & ~tx.rx(t, "^[-–—]"))
    lists = lists.withColumn("__whole", F.coalesce((last > 0) & ~F.array_max("f.__label") & short, F.lit(False)))
    out = lists.select(*line, "__whole", F.explode("f").alias("f"))
    return out.select(*[c if c in line else F.col(f"f.own.{c}").alias(c) for c in frags.columns], F.when(F.col("__whole"), 0).otherwise(F.col("f.piece")).alias("piece"))


def build_lines(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """Text lines out of placed glyphs, with the word spaces that are drawn and those that only the gaps show.

    `glyphs` has line keys + (gno, c, x0, x1, y0, y1, size, icon). Drawn spaces, however many, are one space. Icons do not
    count for the sizes, unless there is nothing else. The glyphs of one printed line become one short array,
    built on the map side already, so whole lines are shuffled instead of single glyphs; the rules then look at each solid
    glyph and the one before it.
    """
    item = F.struct("x0", "gno", "c", "x1", "y0", "y1", "size", "icon")
    rows = glyphs.groupBy(*line).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    spaced = F.transform("__all", lambda g, i: g.withField("drawn", F.coalesce(tx.is_space(F.get("__all", i - 1)["c"]), F.lit(False))))
    rows = rows.withColumn("__g", F.filter(spaced, lambda g: ~tx.is_space(g["c"]))).where(F.size("__g") > 0)

    def beside(g: Column, i: Column) -> Column:
        before = F.get("__g", i - 1)
        return F.struct(g["c"].alias("c"), g["size"].alias("size"), g["icon"].alias("icon"), before["size"].alias("p_size"), (g["drawn"] & (i > 0)).alias("drawn"),
                        (g["icon"] | before["icon"]).alias("any_icon"), (g["x0"] - before["x1"]).alias("gap"))

    rows = rows.withColumn("__s", F.transform("__g", beside))
    words = F.size(F.filter("__s", lambda s: F.coalesce(s["gap"] > s["p_size"], F.lit(False)))) + 1
    digits = F.forall("__g", lambda g: tx.rx(g["c"], r"^\p{Nd}$"))
    rows = rows.withColumn("__cap", F.when((F.size("__g") <= 10) & (words <= 3) & ~digits, 12).otherwise(4))

    def piece(s: Column) -> Column:
        big, small = F.greatest(s["size"], s["p_size"]), F.least(s["size"], s["p_size"])
        space = s["drawn"] | (s["gap"] > 0.25 * big * F.when(s["any_icon"], 0.9).otherwise(1.0)) | ((big > 1.2 * small) & ~s["any_icon"] & (s["gap"] > 0.8))
        wide = (s["gap"] > 3.0 * s["size"]) & ~s["c"].isin(*CIRCLED) & ~s["icon"]
        ems = F.when(wide, F.least("__cap", F.greatest(F.lit(1), F.rint(s["gap"] / s["size"]).cast("int") - 2))).otherwise(0)
        return F.when(F.coalesce(space, F.lit(False)), F.concat(F.repeat(F.lit(EM_SPACE), ems), F.lit(" "), s["c"])).otherwise(s["c"])

    def each(name: str) -> Column:
        return F.transform("__g", lambda g: g[name])

    letters = F.filter("__g", lambda g: ~g["icon"])
    letters = F.when(F.size(letters) > 0, letters).otherwise(F.col("__g"))
    rows = rows.withColumn("__letters", letters)
    sizes, n = F.sort_array(F.transform("__letters", lambda g: g["size"])), F.size("__letters")
    last = F.array_max(each("x0"))
    return rows.select(
        *line, F.array_join(F.transform("__s", piece), "").alias("text"), F.array_min(each("x0")).alias("x0"), F.array_min(each("y0")).alias("y0"),
        F.array_max(each("x1")).alias("x1"), F.array_max(each("y1")).alias("y1"),
        ((F.element_at(sizes, F.floor((n + 1) / 2).cast("int")) + F.element_at(sizes, F.floor((n + 2) / 2).cast("int"))) / 2).alias("size"),
        F.element_at("__letters", 1)["size"].alias("lead_size"),
        F.exists("__all", lambda g: tx.is_space(g["c"]) & (g["x0"] > last)).alias("trailing_space"))


def col_bounds(lines: DataFrame) -> DataFrame:
    """Left and right bound of the text columns: smallest start and the end at nine tenths of the sorted ends.

    `lines` has doc_id, page, col, x0, x1, glyphs (count), in_cell, crosses. Ends are counted per value and the place is
    found by running counts, so no column's ends are collected.
    """
    usable = lines.where((F.col("glyphs") >= 12) & ~F.col("in_cell") & ~F.col("crosses"))
    area = ["doc_id", "page", "col"]
    ends = usable.groupBy(*area, "x1").agg(F.count("*").alias("n"), F.min("x0").alias("left"))
    upto = Window.partitionBy(*area).orderBy("x1")
    whole = Window.partitionBy(*area)
    ranked = ends.withColumns({"__upto": F.sum("n").over(upto), "__all": F.sum("n").over(whole), "left": F.min("left").over(whole)})
    place = F.floor(0.9 * (F.col("__all") - 1))
    return ranked.where(F.col("__upto") > place).groupBy(*area).agg(F.first("left").alias("left"), F.min("x1").alias("right"))


def page_bounds(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds of both columns of every page, by default 36 points from the edge and 14 from the split."""
    both = pages.withColumn("col", F.explode(F.array(F.lit(0), F.lit(1)))).join(bounds, ["doc_id", "page", "col"], "left")
    first = F.col("col") == 0
    return both.withColumns({
        "left": F.coalesce("left", F.when(first, 36.0).otherwise(F.col("split_x") + 14)),
        "right": F.coalesce("right", F.when(first, F.least("split_x", "width") - 14).otherwise(F.col("width") - 36))})


def reading_order(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Position of the items of a page: zone above the divider, left column, right column, zone below.

    `items` has doc_id, page, iid, col, box, x0, y0, x1, y1; `pages` has doc_id, page, split_x, div_y0, div_y1, single. A
    zone exists if one of its items crosses the middle, or two boxes meet there.
    """
    page = ["doc_id", "page"]
    rows = items.join(pages, page)
    crosses = (F.col("x0") < F.col("split_x") - 10) & (F.col("x1") > F.col("split_x") + 10)
    side = F.when(~F.col("single") & (F.col("y1") <= F.col("div_y0") + 3), "up").when(~F.col("single") & (F.col("y0") >= F.col("div_y1") - 3), "down")
    rows = rows.withColumns({"__crosses": crosses, "__side": side})
    sided = rows.where(F.col("__side").isNotNull())
    crossing = sided.where("__crosses").select(*page, "__side").distinct()
    left = sided.where(F.col("box") & (F.abs(F.col("x1") - F.col("split_x")) < 12)).alias("a")
    right = sided.where("box").alias("b")
    meet = left.join(right, [*page, "__side"]).where(
        (F.col("a.iid") != F.col("b.iid")) & (F.abs(F.col("a.x1") - F.col("b.x0")) < 3)
        & (F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0") > 0.6 * F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0"))))
    zones = crossing.unionByName(meet.select(*page, "__side")).distinct().withColumn("__on", F.lit(True))
    placed = rows.join(zones, [*page, "__side"], "left")
    zone = F.when(F.col("__on") & (F.col("__side") == "up"), 0).when(F.col("__on") & (F.col("__side") == "down"), 3).otherwise(
        F.when(F.col("single"), 1).otherwise(F.col("col") + 1))
    order = Window.partitionBy(*page).orderBy("zone", "y0", "x0", "iid")
    return placed.withColumn("zone", zone).withColumn("pos", F.row_number().over(order)).select(*items.columns, "zone", "pos")


def attach_markers(flow: DataFrame) -> DataFrame:
    """Moves a circled digit that stands alone between two aligned lines to the front of the upper one.

    `flow` has doc_id, page, col, ord, kind, text, x0, y0, x1, size. Markers in turn are looked at from the top, and none
    can be a neighbour of another, since the lines around a marker hold more than a digit.
    """
    area = Window.partitionBy("doc_id", "page", "col").orderBy("ord")

    def around(n: int) -> dict[str, Column]:
        return {c: F.lead(c, n).over(area) if n > 0 else F.lag(c, -n).over(area) if n < 0 else F.col(c) for c in ("kind", "text", "x0", "y0", "x1", "size")}

    def marks(a: dict, m: dict, b: dict) -> Column:
        return F.coalesce(
            (a["kind"] == "line") & (m["kind"] == "line") & (b["kind"] == "line") & tx.rx(tx.strip(m["text"]), f"^[{CIRCLED}]$")
            & (a["x0"] > m["x1"]) & (b["x0"] > m["x1"]) & (F.abs(a["x0"] - b["x0"]) < 2) & (a["y0"] < m["y0"]) & (m["y0"] < b["y0"])
            & (b["y0"] - a["y0"] < 2.5 * m["size"]), F.lit(False))

    upper = marks(around(0), around(1), around(2))
    marker = marks(around(-1), around(0), around(1))
    rows = flow.withColumns({"__takes": upper, "__goes": marker, "__text": F.lead("text").over(area), "__x0": F.lead("x0").over(area)})
    return rows.where(~F.col("__goes")).withColumns({
        "text": F.when(F.col("__takes"), F.concat_ws(" ", tx.strip("__text"), "text")).otherwise(F.col("text")),
        "x0": F.when(F.col("__takes"), F.col("__x0")).otherwise(F.col("x0"))}).select(*flow.columns)


def continue_boxes(flow: DataFrame, body: DataFrame) -> DataFrame:
    """Chains boxes that go on in the next column or page: part numbers of one box.

    `flow` has doc_id, page, ord, kind, col, single, fill, y0, y1, top, bottom, titled; `body` has doc_id, body_size.
    """
    names = ("kind", "page", "col", "single", "fill", "y1", "bottom")
    rows = scan.neighbours(flow, ["doc_id"], ["page"], ["ord"], lag={f"p_{c}": F.col(c) for c in names}).join(body, "doc_id")
    goes_on = ((F.col("kind") == "box") & (F.col("p_kind") == "box") & ((F.col("p_page") != F.col("page")) | (F.col("p_col") != F.col("col")))
               & (F.col("p_single") == F.col("single")) & ~F.coalesce(F.col("p_fill") != F.col("fill"), F.lit(False))
               & (F.col("p_y1") >= F.col("p_bottom") - 4 * F.col("body_size")) & (F.col("y0") <= F.col("top") + 4 * F.col("body_size")) & ~F.col("titled"))
    rows = rows.withColumn("__on", F.coalesce(goes_on, F.lit(False)))
    chained = scan.islands(rows, ["doc_id"], ["page"], ["ord"], ~F.col("__on"), "chain")
    return chained.select(*flow.columns, "chain")


def doc_metrics(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Body size (median glyph size) and whether a document follows its source pages (half of two or more are framed).

    Sizes take few values, so they are counted first and the median is found by running counts.
    """
    counts = glyphs.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy("doc_id").orderBy("size"), Window.partitionBy("doc_id")
    ranked = counts.withColumns({"__upto": F.sum("n").over(upto), "__all": F.sum("n").over(whole)})
    half = (F.col("__all") - 1) / 2
    body = ranked.groupBy("doc_id").agg(((F.min(F.when(F.col("__upto") > F.floor(half), F.col("size")))
                                          + F.min(F.when(F.col("__upto") > F.ceil(half), F.col("size")))) / 2).alias("body_size"))
    framed = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("framed").alias("framed"))
    return framed.join(body, "doc_id", "left").select(
        "doc_id", F.coalesce("body_size", F.lit(10.0)).alias("body_size"), ((F.col("pages") >= 2) & (F.col("framed") >= 0.5 * F.col("pages"))).alias("faithful"))


def overlap_groups(rects: DataFrame, area: list[str]) -> DataFrame:
    """Numbers groups of shapes that overlap in x by a fifth of their width."""
    order = Window.partitionBy(*area).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rects.withColumn("__new", (~F.coalesce(F.col("x0") < reach - 0.2 * (F.col("x1") - F.col("x0")), F.lit(False))).cast("int"))
    return rows.withColumn("group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def pick_readings(tokens: DataFrame, region: list[str]) -> DataFrame:
    """Best readings of a region that do not overlap: by falling confidence, a reading is taken if it overlaps each taken
    one by at most 30 % of the shorter.

    `tokens` has region keys + (reading, x0, x1, conf). A region is one printed row with its few competing readings.
    """
    readings = tokens.groupBy(*region, "reading").agg(F.sum(F.greatest(F.col("conf"), F.lit(0.0))).alias("conf"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    lists = readings.groupBy(*region).agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("conf"), "reading", "x0", "x1"))).alias("r"))

    def advance(taken: Column, r: Column) -> Column:
        free = F.forall(taken, lambda t: F.least(r["x1"], t["x1"]) - F.greatest(r["x0"], t["x0"]) <= 0.3 * F.least(r["x1"] - r["x0"], t["x1"] - t["x0"]))
        return F.when(free, F.concat(taken, F.array(r))).otherwise(taken)

    picked = F.aggregate("r", F.slice("r", 1, 0), advance)
    return lists.select(*region, F.explode(F.transform(picked, lambda r: r["reading"])).alias("reading"))


def confident_regions(chars: DataFrame, region: list[str], low: float = 60.0) -> DataFrame:
    """Regions with at most a quarter of their characters under the confidence limit."""
    return chars.groupBy(*region).agg(F.count("*").alias("n"), F.count_if(F.col("conf") < low).alias("low")).where(F.col("low") <= 0.25 * F.col("n"))


def consensus(tokens: DataFrame) -> DataFrame:
    """Relabels readings of a shape that was read twice or more as one letter, twice as often as this way, in 60 %.

    `tokens` has shape, c and any other columns. Votes are counted first; a shape read very often joins one row.
    """
    votes = tokens.groupBy("shape", "c").agg(F.count("*").alias("n"))
    tops = votes.groupBy("shape").agg(F.sum("n").alias("__all"), F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("m"))
    plan = votes.join(tops, "shape").select("shape", "c", F.when(
        (-F.col("m.n") >= 2) & (-F.col("m.n") >= 2 * F.col("n")) & (-F.col("m.n") >= 0.6 * F.col("__all")) & (F.col("c") != F.col("m.c")), F.col("m.c")).alias("__to"))
    fixes = plan.where("__to is not null")
    return tokens.join(fixes, ["shape", "c"], "left").withColumn("c", F.coalesce("__to", "c")).drop("__to")


def body_vocab(lines: DataFrame, pattern: str, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of each document's body text with their counts."""
    return lines.select(*scope, F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("word")).groupBy(*scope, "word").agg(F.count("*").alias("n"))


def _looked_up(asked: DataFrame, vocab: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Adds to rows of scope + word whether the word is in the vocabulary of its scope (known) and whether it starts a word of it (starts).

    Backwards in order, the last vocabulary word passed is the first one not before the asked word; if any word starts with
    it, this one does. Words meet by scope and first letter.
    """
    rows = vocab.dropna(subset=list(scope)).select(*scope, "word").withColumn("__entry", F.lit(True)).unionByName(asked.withColumn("__entry", F.lit(False)), allowMissingColumns=True)
    area = Window.partitionBy(*scope, "__letter").orderBy(F.desc("word"), F.desc("__entry")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__letter", F.substring("word", 1, 1)).withColumn("__next", F.last(F.when(F.col("__entry"), F.col("word")), ignorenulls=True).over(area))
    no = F.lit(False)
    return rows.where(~F.col("__entry")).select(*asked.columns, F.coalesce(F.col("__next") == F.col("word"), no).alias("known"), F.coalesce(F.col("__next").startswith(F.col("word")), no).alias("starts"))


def vocab_fix(words: DataFrame, vocab: DataFrame, swaps: Column, min_count: int = 3, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Corrects recognised words by the one body word of their document that differs in a single character.

    `words` has scope + word (distinct unknown ones are looked up once); a word that is in its document's vocabulary or
    starts a body word stays. `swaps` is a condition on columns a and b, the differing characters. Candidates meet on the
    document and the word with one character masked, an equality key; no word is compared with all others.
    """
    asked = words.select(*scope, "word").where(F.length("word") >= 2)
    unknown = _looked_up(asked, vocab, scope).where("not starts").select(*scope, "word").distinct()

    # words that differ in one character have one half alike; they are dealt by it before they grow into masked words
    deal = [*scope, "__length", "__side", "__half"]

    def masked(df: DataFrame, name: str) -> DataFrame:
        length, middle = F.length("word"), F.ceil(F.length("word") / 2).cast("int")
        halves = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), middle).alias("half"), (middle + 1).alias("low"), length.alias("high")),
                         F.struct(F.lit(1).alias("side"), F.substring("word", middle + 1, length).alias("half"), F.lit(1).alias("low"), middle.alias("high")))
        rows = df.select(*scope, F.col("word").alias(name), length.alias("__length"), F.explode(halves).alias("h")).where("h.low <= h.high").select(
            *scope, name, "__length", F.col("h.side").alias("__side"), F.col("h.half").alias("__half"), "h.low", "h.high").repartition(*deal)
        return rows.select(*deal, name, F.explode(F.sequence("low", "high")).alias("i")).select(
            *deal, name, "i", F.concat(F.substring(name, F.lit(1), F.col("i") - 1), F.lit("\x01"), F.substring(name, F.col("i") + 1, F.length(name))).alias("key"),
            F.substring(name, F.col("i"), F.lit(1)).alias("a" if name == "word" else "b"))

    pairs = masked(unknown, "word").join(masked(vocab.where(F.col("n") >= min_count), "fixed"), [*deal, "key", "i"]).where(swaps & (F.col("a") != F.col("b")))
    return pairs.groupBy(*scope, "word").agg(F.count("*").alias("n"), F.min("fixed").alias("fixed")).where("n = 1").select(*scope, "word", "fixed")


def final_consonant_swap(conventions: Conventions = KOREAN) -> Column:
    """The two syllables differ in their final consonant only, ㅁ against ㅂ, and neither is a particle."""
    a, b = F.ascii("a") - 44032, F.ascii("b") - 44032
    plain = ~F.col("a").isin(*conventions.particle_syllables) & ~F.col("b").isin(*conventions.particle_syllables)
    return plain & (F.floor(a / 28) == F.floor(b / 28)) & (F.least(a % 28, b % 28) == 16) & (F.greatest(a % 28, b % 28) == 17)


def line_end_space(pairs: DataFrame, vocab: DataFrame, conventions: Conventions = KOREAN, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Whether a line ends in a space, from its last word and the first word of the line below.

    `pairs` has scope + w1, w2. A joined word that starts a body word of its document means no space, as does a particle below; an ending, or two
    words both known, means a space. The columns of pairs must be comparable.
    """
    asked = pairs.withColumn("__a", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), w.alias("word")) for k, w in enumerate((F.concat("w1", "w2"), F.col("w1"), F.col("w2")))])))
    found = _looked_up(asked.select(*pairs.columns, F.col("__a.k").alias("__k"), F.col("__a.word").alias("word")), vocab, scope)
    # equal rows of pairs get equal answers, so each stands for as many as there are
    rows = found.groupBy(*pairs.columns).agg(F.count_if(F.col("__k") == 0).alias("__copies"), *[
        F.bool_or(F.col(c) & (F.col("__k") == k)).alias(n) for k, c, n in ((0, "starts", "__joined"), (1, "known", "__w1"), (2, "starts", "__w2"))])
    last = F.substring("w1", -1, 1)
    code = F.ascii(last) - 44032
    ending = (F.length("w1") >= 2) & (last.isin(*conventions.endings) | (code.between(0, 11171) & (code % 28).isin(4, 8)))
    particle = F.col("w2").startswith("으") | F.col("w2").isin(*conventions.particles)
    space = ~F.col("__joined") & ~particle & (ending | (F.col("__w1") & F.col("__w2")))
    each = rows.withColumn("space", space).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return each.select(*pairs.columns, "space")


def line_below(lines: DataFrame) -> DataFrame:
    """Nearest line below each line of a page column, 0.6 to 2.8 line heights away and overlapping in x."""
    a, b = lines.alias("a"), lines.alias("b")
    h = F.col("a.y1") - F.col("a.y0")
    dy = F.col("b.y0") - F.col("a.y0")
    pairs = a.join(b, ["doc_id", "page", "col"]).where(
        (dy > 0.6 * h) & (dy < 2.8 * h) & (F.least("a.x1", "b.x1") > F.greatest("a.x0", "b.x0")) & (F.col("a.ord") != F.col("b.ord")))
    return pairs.groupBy("doc_id", "page", "col", F.col("a.ord").alias("ord")).agg(F.min_by(F.col("b.ord"), F.struct("b.y0", "b.ord")).alias("below"))


def pill_word(lines: DataFrame, pattern: str) -> DataFrame:
    """Most frequent word named in brackets with a number; the first seen on ties."""
    found = lines.select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("k", "word"))
    counts = found.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("ord", "k")).alias("seen"))
    return counts.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "word")).alias("m")).select("doc_id", F.col("m.word").alias("word"), (-F.col("m.n")).alias("n"))


def extract_stats(counters: DataFrame) -> DataFrame:
    """Named counters of each document as one map. `counters` has doc_id, name, n."""
    sums = counters.groupBy("doc_id", "name").agg(F.sum("n").alias("n"))
    return sums.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("stats"))
