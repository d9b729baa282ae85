"""Cleanup of glyphs, runs and settings: filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as tx

HIDDEN_SIZE = 3.0
# Symbol font characters and the signs they draw.
SYMBOLS = {
    "ü": "✓", "û": "✗", "ý": "☒", "þ": "☑", "è": "→", "ç": "←", "é": "↑", "ê": "↓", "ð": "⇨", "ï": "⇦", "ñ": "⇧",
    "ò": "⇩", "l": "●", "n": "■", "u": "◆", "§": "▪", "o": "□", "¡": "○",
}
MISMAPPED = "$%#&@�"
PT = 110  # output units per point
PAPER_W, PAPER_H, COLUMN_GAP = 59528, 84186, 2268
MARGINS = {"header": 1134, "footer": 1134, "left": 2268, "right": 2268, "top": 2268, "bottom": 2268}
MARGINS_MASTER = {"header": 4251, "footer": 4251, "left": 4251, "right": 4251, "top": 4251, "bottom": 2834}


def drop_hidden(glyphs: DataFrame) -> DataFrame:
    return glyphs.where(F.col("size") >= HIDDEN_SIZE)


def remap_symbols(glyphs: DataFrame) -> DataFrame:
    """Characters of symbol and equation fonts as Unicode; small equation digits become superscripts of line size.

    The line maximum is a window over one text fragment, which is a single drawn row.
    """
    equation = {chr(0xE000 + k): chr(65 + k) for k in range(26)} | {chr(0xE033 + k): str(k) for k in range(10)}
    equation[chr(0xE054)] = "/"
    font = F.lower("font")
    symbol, formula = font.contains("wingdings"), font.contains("hancomeqn")
    plain = (F.when(symbol, F.translate("c", "".join(SYMBOLS), "".join(SYMBOLS.values())))
             .when(formula, F.translate("c", "".join(equation), "".join(equation.values()))).otherwise(F.col("c")))
    row = Window.partitionBy("doc_id", "page", "frag")
    raised = formula & tx.rx(F.col("c"), r"^\p{Nd}$") & (F.col("size") < 0.8 * F.col("__max"))
    return (
        glyphs.withColumn("c", plain).withColumn("__max", F.max("size").over(row)).withColumn("__up", raised)
        .withColumn("c", F.when(F.col("__up"), F.translate("c", "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")).otherwise(F.col("c")))
        .withColumn("size", F.when(F.col("__up"), F.col("__max")).otherwise(F.col("size"))).drop("__max", "__up"))


def fix_spaces(glyphs: DataFrame) -> DataFrame:
    """A narrow sign that stands where the font keeps its space."""
    narrow = F.col("c").isin(*MISMAPPED) & (F.col("x1") - F.col("x0") < 0.36 * F.col("size"))
    return glyphs.withColumn("c", F.when(narrow, " ").otherwise(F.col("c")))


def fix_unknown(glyphs: DataFrame) -> DataFrame:
    """Unknown characters by their ink area: none is a space, a dot is a bullet."""
    unknown = F.col("c") == "�"
    return glyphs.withColumn("c", F.when(unknown & (F.col("ink") == 0), " ").when(
        unknown & (F.col("ink") <= 0.06 * F.col("size") * F.col("size")), "•").otherwise(F.col("c")))


def dedupe_overprint(glyphs: DataFrame) -> DataFrame:
    """Drops a character printed again almost on the last kept one (fake bold).

    The glyphs of one row become one short array, folded in the JVM: a character is only compared with the last kept one.
    """
    row = ["doc_id", "page", "frag"]
    rest = [c for c in glyphs.columns if c not in (*row, "gno")]
    lists = glyphs.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("gno", *rest))).alias("g"))

    def again(last: Column, x: Column) -> Column:
        return F.coalesce((last["c"] == x["c"]) & (F.abs(last["x0"] - x["x0"]) < 0.3 * x["size"]), F.lit(False))

    # a run of which no glyph lies on the one before it stays whole, so only rows with such a glyph are folded
    doubled = F.exists(F.sequence(F.lit(1), F.size("g")), lambda i: again(F.get("g", i - 1), F.get("g", i)))
    kept = F.aggregate(F.slice("g", F.lit(2), F.size("g")), F.slice("g", 1, 1),
                       lambda kept, x: F.when(again(F.element_at(kept, -1), x), kept).otherwise(F.concat(kept, F.array(x))))
    # an inner generator would fold once more, to filter by size; no row is empty
    return lists.select(*row, F.inline_outer(F.when(doubled, kept).otherwise(F.col("g")))).select(*glyphs.columns)


def clean_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Collapses blanks in runs, joins neighbours of one look, trims the ends; underlined blanks keep their length.

    `runs` has keys + (ord, text, underline, look); a key is one paragraph.
    """
    blank = F.col("underline") & (tx.strip("text") == "")
    rows = runs.withColumn("text", F.when(blank, F.col("text")).otherwise(F.regexp_replace("text", r"[ \t]{2,}", " ")))
    rows = rows.where(F.length("text") > 0)
    para = Window.partitionBy(*keys).orderBy("ord")
    changed = (F.lag("underline").over(para) != F.col("underline")) | (F.lag("look").over(para) != F.col("look"))
    rows = rows.withColumn("__n", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(para))
    joined = rows.groupBy(*keys, "__n").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))),
                                                            lambda r: r["text"]), "").alias("text"),
        F.first("underline").alias("underline"), F.first("look").alias("look"))
    whole = Window.partitionBy(*keys)
    last = F.col("__n") == F.max("__n").over(whole)
    keeps = F.col("underline") & (tx.strip("text") == "")
    left = F.when(F.col("__n") == F.min("__n").over(whole), F.regexp_replace("text", rf"^{tx.SPACE}+", "")).otherwise(
        F.col("text"))
    out = joined.withColumn("__last", last & ~keeps).withColumn("text", left)
    out = out.withColumn("text", F.when(F.col("__last"), F.regexp_replace("text", rf"{tx.SPACE}+$", "")).otherwise(
        F.col("text")))
    return out.where(F.length("text") > 0).select(*keys, "ord", "text", "underline", "look")


def clamp_settings(df: DataFrame) -> DataFrame:
    """Output settings held in their ranges, with defaults, and what they imply."""

    def size(name: str, low: float, high: float, default: float) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.col(name), F.lit(default))))

    def short(name: str, n: int) -> Column:
        return F.substring(tx.strip(F.coalesce(F.col(name), F.lit(""))), 1, n)

    colour = tx.strip(F.coalesce(F.col("title_color"), F.lit("")))
    out = df.withColumns({
        "body_size": size("body_size", 7.0, 16.0, 10.0), "title_size": size("title_size", 9.0, 24.0, 13.0),
        "academy_size": size("academy_size", 8.0, 24.0, 12.0),
        "academy_name": short("academy_name", 30), "title": short("title", 80),
        "title_color": F.when(tx.rx(colour, r"^#[0-9A-Fa-f]{6}$"), F.upper(colour)).otherwise("#000000"),
        "body_font": F.coalesce(F.nullif(short("body_font", 40), F.lit("")), F.lit("함초롬바탕")),
    })
    return out.withColumn("header_enabled", (F.col("academy_name") != "") | (F.col("title") != "")).withColumn(
        "uses_masterpage", F.col("header_enabled") | F.coalesce("frame", F.lit(False)))


def parse_access(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Access list 'name:key,…' as rows; keys under eight characters are ignored, the last entry of a key wins."""
    parts = df.select(*[c for c in df.columns if c != raw], F.posexplode(F.split(raw, ",")).alias("pos", "part"))
    part = tx.strip("part")
    rows = parts.withColumns({
        "key": F.regexp_extract(part, r"([^:]*)$", 1), "name": F.regexp_extract(part, r"^(.*):[^:]*$", 1)})
    keys = [c for c in df.columns if c != raw]
    return rows.where(F.length("key") >= 8).groupBy(*keys, "key").agg(
        F.coalesce(F.nullif(F.max_by("name", "pos"), F.lit("")), F.lit("user")).alias("name"))


def admit(jobs: DataFrame, max_bytes: int = 40 * 1024 * 1024, max_pages: int = 200) -> DataFrame:
    """First reason to reject an upload, or null."""
    return jobs.withColumn("reason", F.when(F.col("size") > max_bytes, "too_large").when(
        ~F.col("header").startswith("%PDF"), "not_pdf").when(F.col("pages") > max_pages, "too_many_pages"))


def admit_bundle(members: DataFrame, max_files: int = 10, max_pages: int = 200) -> DataFrame:
    """First reason to reject a bundle, or null."""
    groups = members.groupBy("bundle").agg(
        F.count("*").alias("files"), F.sum("pages").cast("long").alias("pages"), F.count_distinct("job").alias("jobs"))
    return groups.select("bundle", "files", "pages", F.when(F.col("files") > max_files, "too_many_files").when(
        F.col("jobs") != F.col("files"), "duplicate").when(F.col("files") < 2, "too_few").when(
        F.col("pages") > max_pages, "too_many_pages").alias("reason"))


def encode_styles(paras: DataFrame, scope: list[str], order: list[str], style: list[str]) -> DataFrame:
    """Dense style ids by first appearance; the dictionary has one row per distinct style and is joined back."""
    firsts = paras.groupBy(*scope, *style).agg(F.min(F.struct(*order)).alias("__first"))
    ids = firsts.withColumn("style_id", F.row_number().over(Window.partitionBy(*scope).orderBy("__first"))).drop("__first")
    return paras.join(ids, [*scope, *style])


def run_look(runs: DataFrame, body_size: float = 10.0) -> DataFrame:
    """Size override of a run in hundredths of a point: only if it differs by 8 % or more, in half points, 500-3000."""
    half = F.floor(F.rint(F.lit(body_size) * F.col("rel") * 2) / 2 * 100)
    height = F.when((F.col("size") > 0) & (F.abs(F.col("rel") - 1.0) >= 0.08),
                    F.greatest(F.lit(500), F.least(half, F.lit(3000))))
    return runs.withColumn("height", F.coalesce(height, F.lit(0)).cast("int"))


def fit_images(images: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """Image size in output units, scaled to fit the column and the page, at least 200."""
    w = F.floor(F.col("width") * PT)
    h = F.floor(F.col("height") * PT)
    out = images.withColumns({"out_w": w, "out_h": h})
    out = out.withColumns({
        "out_h": F.when(F.col("out_w") > max_w, F.floor(F.col("out_h") * max_w / F.col("out_w"))).otherwise(F.col("out_h")),
        "out_w": F.least("out_w", F.lit(max_w))})
    out = out.withColumns({
        "out_w": F.when(F.col("out_h") > max_h, F.floor(F.col("out_w") * max_h / F.col("out_h"))).otherwise(F.col("out_w")),
        "out_h": F.least("out_h", F.lit(max_h))})
    return out.withColumns({c: F.greatest(c, F.lit(200)).cast("long") for c in ("out_w", "out_h")})


def share_width(items: DataFrame, row: list[str], width: int, gap: int) -> DataFrame:
    """Widths of the items of a row in proportion to their source widths, after a gap between items."""
    total = items.groupBy(*row).agg(F.sum("width").alias("__sum"), F.count("*").alias("__n"))
    room = F.lit(width) - F.lit(gap) * (F.col("__n") - 1)
    share = F.floor(room * F.col("width") / F.when(F.col("__sum") == 0, 1.0).otherwise(F.col("__sum")))
    return items.join(total, row).withColumn("share", share.cast("long")).drop("__sum", "__n")


def header_width(settings: DataFrame) -> DataFrame:
    """Width of the name cell in a page header."""
    name = F.length("academy_name") * F.col("academy_size")
    sub = F.when(F.col("academy_sub") != "", (F.length("academy_sub") + F.when(F.col("academy_name") != "", 0.5)
                                               .otherwise(0.0)) * F.col("academy_sub_size")).otherwise(0.0)
    width = F.floor((name + sub) * 98) + 1600
    return settings.withColumn("cell_width", F.greatest(F.lit(6000), F.least(F.lit(20000), width)).cast("long"))


def indent_units(points: Column) -> Column:
    """Indent in output units, in tens, within ±3000."""
    return F.greatest(F.lit(-3000), F.least(F.lit(3000), F.rint(points * 11).cast("int") * 10))


def hang_units(units: Column, body_size: Column) -> Column:
    """A hanging indent that grows with the body size."""
    return (F.rint(units * body_size / 100) * 10).cast("int")
