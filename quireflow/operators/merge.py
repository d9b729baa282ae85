"""Merging and renumbering documents, and planning the pages of the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.conventions import SPACE
from quireflow.functions import scan
from quireflow.functions import text as tx
from quireflow.operators.cleanup import COLUMN_GAP, MARGINS, PAPER_H, PAPER_W, PT

LINE_PCT = 155
KEEP_CHARS = 300
ANSWER_PREFIX = rf"^{SPACE}*\p{{Nd}}{{1,3}}{SPACE}*\){SPACE}*"
STEM_PREFIX = rf"^{SPACE}*\p{{Nd}}{{1,3}}{SPACE}*\.{SPACE}*"


def merge_shifts(files: DataFrame) -> DataFrame:
    """Number shift and passage offset of each file of a bundle.

    `files` has bundle, file_ord, low, high (smallest and largest number of its questions, else of its answers; null if
    it has neither), max_passage. Numbers move as a block, so a file's offset is the running sum of the spans before it.
    A bundle has at most ten files.
    """
    before = Window.partitionBy("bundle").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    span = F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0))
    shift = F.coalesce(F.sum(span).over(before), F.lit(0)) - (F.coalesce("low", F.lit(1)) - 1)
    passages = F.coalesce(F.sum(F.coalesce("max_passage", F.lit(0))).over(before), F.lit(0))
    return files.select("bundle", "file_ord", shift.cast("int").alias("shift"), passages.cast("int").alias("passage_offset"))


def file_spans(items: DataFrame) -> DataFrame:
    """Number span of each file. `items` has bundle, file_ord, kind, number, passage_id."""
    question, answer = F.col("kind") == "question", F.col("kind") == "answer"

    def low(cond: Column) -> Column:
        return F.min(F.when(cond, F.col("number")))

    return items.groupBy("bundle", "file_ord").agg(
        F.coalesce(low(question), low(answer)).alias("low"),
        F.max(F.when(question | answer, F.col("number"))).alias("high"), F.max("passage_id").alias("max_passage"))


def merge_docs(items: DataFrame) -> DataFrame:
    """Items of all files of a bundle, renumbered so that each file goes on where the one before ended."""
    shifts = merge_shifts(file_spans(items))
    return items.join(shifts, ["bundle", "file_ord"]).withColumns({
        "new_number": (F.col("number") + F.col("shift")).cast("int"), "new_passage": F.col("passage_id") + F.col("passage_offset")})


def shift_first(text: Column, shift: Column, mark: str) -> Column:
    """The number printed at the start of a text, before `mark`, moved by `shift`."""
    pattern = rf"(?s)^({SPACE}*)(\p{{Nd}}{{1,3}})({SPACE}*{mark}.*)$"
    number = F.regexp_extract(text, pattern, 2)
    moved = F.concat(F.regexp_extract(text, pattern, 1), (number.cast("int") + shift).cast("string"), F.regexp_extract(text, pattern, 3))
    return F.when(number != "", moved).otherwise(text)


def shift_ranges(text: Column, shift: Column) -> Column:
    """Every [a~b] of a text moved by `shift`: the text is split around the ranges and put together again."""
    pattern = rf"\[{SPACE}*\p{{Nd}}{{1,3}}{SPACE}*[~∼～\-–]{SPACE}*\p{{Nd}}{{1,3}}{SPACE}*\]"
    parts = rf"(\[{SPACE}*)(\p{{Nd}}{{1,3}})({SPACE}*[~∼～\-–]{SPACE}*)(\p{{Nd}}{{1,3}})({SPACE}*\])"
    between = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def moved(piece: Column) -> Column:
        g = [F.regexp_extract(piece, parts, k) for k in range(1, 6)]
        return F.concat(g[0], (g[1].cast("int") + shift).cast("string"), g[2], (g[3].cast("int") + shift).cast("string"), g[4])

    return F.array_join(F.transform(between, lambda piece, i: F.concat(
        piece, F.coalesce(moved(F.get(found, i)), F.lit("")))), "")


def rewrite_numbers(texts: DataFrame) -> DataFrame:
    """Printed numbers of stems, answer heads and guides after the shift. `texts` has kind, text, shift."""
    text, shift = F.col("text"), F.col("shift")
    return texts.withColumn("text", F.when(F.col("kind") == "question", shift_first(text, shift, r"\."))
                            .when(F.col("kind") == "answer", shift_first(text, shift, r"\)")).otherwise(shift_ranges(text, shift)))


def replace_in_runs(runs: Column, start: Column, end: Column, new: Column) -> Column:
    """Replaces the characters [start, end) of the joined run texts; the new text takes the look of the first run hit.

    `runs` is one paragraph's array of structs with `text` and `at` (offset of the run in the paragraph) and `underline`.
    """
    def edit(run: Column) -> Column:
        low = F.greatest(run["at"], start)
        high = F.least(run["at"] + F.length(run["text"]), end)
        hit = low < high
        first = hit & (start >= run["at"])
        head = F.substring(run["text"], F.lit(1), low - run["at"])
        tail = F.substring(run["text"], high - run["at"] + 1, F.length(run["text"]))
        text = F.when(hit, F.concat(head, F.when(first, new).otherwise(""), tail)).otherwise(run["text"])
        return F.struct(text.alias("text"), run["underline"].alias("underline"))
    return F.transform(runs, edit)


def merge_stats(docs: DataFrame) -> DataFrame:
    """Numeric statistics of the merged files added up, as one map per bundle."""
    rows = docs.select("bundle", F.explode("stats").alias("name", "value"))
    sums = rows.groupBy("bundle", "name").agg(F.sum("value").alias("value"))
    files = docs.groupBy("bundle").agg(F.count("*").cast("double").alias("value")).select("bundle", F.lit("merged_files").alias("name"), "value")
    return sums.unionByName(files).groupBy("bundle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("stats"))


def merge_warnings(docs: DataFrame) -> DataFrame:
    """Warnings with the name of their file in front, and a note for files without questions."""
    none = F.when(F.col("questions") == 0, F.array(F.lit("문제를 찾지 못해 내용만 옮겼습니다(자동 번호·정답 미주 없음)"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("bundle", "file_ord", "name", F.posexplode(F.concat("warnings", none)).alias("no", "warning"))
    return rows.select("bundle", "file_ord", "no", F.concat("name", F.lit(": "), "warning").alias("warning"))


def plan_notes(questions: DataFrame, answers: DataFrame, auto: bool = True) -> DataFrame:
    """Note of each question: its answer, or a placeholder in automatic mode, and the number it shows.

    The first answer of a number pairs with the question. Automatic notes count on from the first question; literal notes
    restart where the number does not follow the one before. Documents without any pair get no notes.
    """
    first = answers.groupBy("doc_id", "number").agg(F.min("ord").alias("answer_ord"))
    both = questions.join(first, ["doc_id", "number"], "left")
    some = both.where("answer_ord is not null").select("doc_id").distinct()
    both = both.join(some, "doc_id", "left_semi")
    if not auto:
        kept = both.where("answer_ord is not null")
        steps = scan.neighbours(kept, ["doc_id"], ["chunk"], ["ord"], lag={"prev": F.col("number")})
        return steps.select("doc_id", "ord", F.col("number").alias("note"), F.lit(False).alias("placeholder"),
                            F.coalesce(F.col("number") != F.col("prev") + 1, F.lit(False)).alias("restart"))
    start = questions.groupBy("doc_id").agg(F.min_by("number", F.struct("chunk", "ord")).alias("__start"))
    placed = scan.numbered(both, ["doc_id"], ["chunk"], ["ord"], "__no").join(start, "doc_id")
    return placed.select("doc_id", "ord", (F.col("__start") + F.col("__no") - 1).cast("int").alias("note"),
                         F.col("answer_ord").isNull().alias("placeholder"), F.lit(False).alias("restart"))


def leftover_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that pair with no question: repeats of a number, and numbers without question."""
    first = answers.groupBy("doc_id", "number").agg(F.min("ord").alias("ord"))
    used = first.join(questions.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")
    return answers.join(used, ["doc_id", "number", "ord"], "left_anti")


def number_gaps(questions: DataFrame) -> DataFrame:
    """Places where the next number is not one more."""
    steps = scan.neighbours(questions, ["doc_id"], ["chunk"], ["ord"], lead={"next": F.col("number")})
    return steps.where(F.col("next") != F.col("number") + 1).select(
        "doc_id", "ord", F.concat(F.col("number").cast("string"), F.lit("→"), F.col("next").cast("string")).alias("gap"))


def page_scales(items: DataFrame, margins: dict[str, int] = MARGINS) -> DataFrame:
    """Scale of each source page's content, so that it fits an output page.

    `items` has doc_id, chunk, ord, top (first of its source page), y0, y1 (null without a source place).
    """
    room = 0.92 * (PAPER_H - sum(margins[k] for k in ("top", "bottom", "header", "footer"))) / PT
    pages = scan.islands(items, ["doc_id"], ["chunk"], ["ord"], F.col("top"), "group")
    spans = pages.groupBy("doc_id", "group").agg((F.max("y1") - F.min("y0")).alias("span"))
    return spans.select("doc_id", "group", F.when(F.col("span") > room, F.lit(room) / F.col("span")).otherwise(1.0).alias("scale"))


def plan_breaks(items: DataFrame) -> DataFrame:
    """Column switches, page and column breaks, blanks to drop before a page break, and headings kept with what follows.

    `items` has doc_id, chunk, ord, kind, text, wide, top, col_break, faithful. Only items that produce paragraphs are in.
    """
    near = scan.neighbours(items, ["doc_id"], ["chunk"], ["ord"], lag={"p_wide": F.col("wide")},
                           lead={"n_wide": F.col("wide"), "n_kind": F.col("kind")})
    first = F.col("p_wide").isNull()
    top = F.col("top") & ~first
    switch = ~first & (F.col("wide") != F.col("p_wide"))
    page_break = F.when(switch, top).otherwise(top & (F.col("wide") | F.col("faithful")))
    col_break = ~switch & ~page_break & F.col("col_break") & ~F.col("wide")
    keep = (F.col("wide") & (F.col("kind") == "text") & (F.length("text") <= 40) & F.coalesce("n_wide", F.lit(False))
            & F.coalesce(F.col("n_kind").isin("box", "table", "image"), F.lit(False)))
    rows = near.withColumns({"switch": switch, "page_break": page_break, "column_break": col_break, "keep_next": keep})
    # a blank goes if only blanks stand between it and the next page break: look backwards for the next non-blank
    back = rows.withColumns({"__chunk": -F.col("chunk"), "__ord": -F.col("ord")})
    blank = (F.col("kind") == "blank") & ~F.col("page_break")
    seen = scan.running(back, ["doc_id"], ["__chunk"], ["__ord"], lasts={"__next": F.when(~blank, F.col("page_break"))})
    return seen.select("doc_id", "ord", "switch", "page_break", "column_break", "keep_next",
                       (blank & F.coalesce("__next", F.lit(False))).alias("dropped"))


def keep_with_figure(paras: DataFrame) -> DataFrame:
    """Passage paragraphs that stay with the first picture or table, if the text before it is short.

    `paras` has doc_id, passage, ord, kind, text.
    """
    big = F.col("kind").isin("image", "table")
    firsts = paras.groupBy("doc_id", "passage").agg(F.min(F.when(big, F.col("ord"))).alias("first_big"))
    before = paras.join(firsts.where("first_big is not null"), ["doc_id", "passage"]).where("ord < first_big")
    sizes = before.groupBy("doc_id", "passage").agg(F.sum(F.when(F.col("kind") == "text", F.length("text")).otherwise(0)).alias("chars"))
    return before.join(sizes.where(F.col("chars") <= KEEP_CHARS), ["doc_id", "passage"]).select("doc_id", "passage", "ord")


def fit_grid(columns: DataFrame, key: list[str], available: int) -> DataFrame:
    """Column widths of a choice grid: at least what the text needs; the excess comes out of columns with slack, and what
    is left scales all. `columns` has key + (col, width, need)."""
    grid = columns.withColumn("w", F.greatest("width", "need"))
    grid = grid.withColumn("slack", F.col("w") - F.col("need"))
    sums = grid.groupBy(*key).agg(F.sum("w").alias("__w"), F.sum("slack").alias("__slack"))
    out = grid.join(sums, key).withColumn("__over", F.greatest(F.col("__w") - available, F.lit(0)))
    given = F.when(F.col("__slack") >= F.col("__over"), F.floor(F.col("__over") * F.col("slack") / F.greatest("__slack", F.lit(1)))).otherwise(F.col("slack"))
    out = out.withColumn("w", F.col("w") - given)
    total = out.groupBy(*key).agg(F.sum("w").alias("__total"))
    scaled = F.when((F.col("__over") > 0) & (F.col("__total") > available), F.floor(F.col("w") * available / F.col("__total"))).otherwise(F.col("w"))
    return out.join(total, key).withColumn("fitted", scaled.cast("long")).select(*columns.columns, "fitted")


def fit_table(tables: DataFrame, max_w: int, body_size: float = 10.0) -> DataFrame:
    """Column and row edges of a table in output units.

    Proportional to the source, shrunk to the column. A layout table (text_pt set) keeps its scale in all but the last
    column if at least 40 % of that column remain. `tables` has xs, ys (arrays of edges) and text_pt.
    """
    ky = F.when(F.col("text_pt") > 0, F.lit(body_size * 100) / F.col("text_pt")).otherwise(float(PT))
    k = F.least(ky, F.lit(float(max_w)) / F.greatest(F.lit(1.0), F.element_at("xs", -1) - F.element_at("xs", 1)))

    def edges(column: str, scale: Column) -> Column:
        return F.transform(column, lambda v: F.rint((v - F.element_at(column, 1)) * scale).cast("int"))

    full = edges("xs", ky)
    last = F.element_at(full, -1) - F.element_at(full, -2)
    absorb = ((F.col("text_pt") > 0) & (k < ky) & (F.size("xs") >= 3)
              & (F.lit(max_w) - F.element_at(full, -2) >= 0.4 * last))
    out = F.when(absorb, F.concat(F.slice(full, F.lit(1), F.size("xs") - 1), F.array(F.lit(max_w)))).otherwise(edges("xs", k))
    return tables.withColumns({"out_xs": out, "out_ys": edges("ys", ky)})


def emit_rows(items: DataFrame) -> DataFrame:
    """Paragraph rows an item is written as: one, plus a spacer behind a box, plus two blank lines behind a written
    question without choices."""
    extra = F.when((F.col("kind") == "question") & (F.col("qtype") == "subjective") & (F.col("choices") == 0), 2).when(F.col("kind") == "box", 1).otherwise(0)
    return items.withColumn("row", F.explode(F.sequence(F.lit(0), extra))).withColumn(
        "row_kind", F.when(F.col("row") == 0, F.col("kind")).when(F.col("kind") == "box", "spacer").otherwise("blank"))


def strip_prefix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def strip_prefix_runs(runs: Column, cut: Column) -> Column:
    """Drops the first `cut` characters of a paragraph's runs; runs that become empty go. Runs carry `at` offsets."""
    kept = F.filter(runs, lambda r: (r["at"] + F.length(r["text"]) > cut) & (F.length(r["text"]) > 0))
    return F.transform(kept, lambda r: F.struct(
        F.substring(r["text"], F.greatest(F.lit(1), cut - r["at"] + 1), F.length(r["text"])).alias("text"), r["underline"].alias("underline")))


def spacing_plan(paras: DataFrame, body_size: float = 10.0) -> DataFrame:
    """Line spacing and gap above a paragraph of a document that follows its source pages."""
    scaled = (F.col("scale") < 1.0) & (F.col("kind") == "text")
    base = F.when(F.col("line_pct") > 0, F.col("line_pct")).otherwise(LINE_PCT)
    line = F.when(scaled, F.greatest(F.lit(100), F.rint(base * F.col("scale")).cast("int"))).otherwise(F.col("line_pct"))
    return paras.withColumns({"line": line, "space_above": F.when(
        F.col("gap") > 0, F.floor(F.col("gap") * body_size * 100 * F.col("scale"))).otherwise(0).cast("int")})


def width_plan(items: DataFrame, margins: dict[str, int] = MARGINS) -> DataFrame:
    """Width available to an item, and to pictures in a box and outside."""
    full = PAPER_W - margins["left"] - margins["right"]
    width = F.when(F.col("wide"), full).otherwise((full - COLUMN_GAP) // 2)
    return items.withColumn("width", width).withColumns({"in_box": F.col("width") - 3000, "free": F.col("width") - 600})
