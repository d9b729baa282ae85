"""From placed glyphs to checked documents: the operators of layout, structure and quality, one after the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.conventions import KOREAN, Conventions
from quireflow.functions import text as tx
from quireflow.operators import layout, quality, structure
from quireflow.session import settle

LINE = ["doc_id", "page", "col", "frag"]


def lines_of(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Printed lines in reading order, without repeated headers and footers.

    `glyphs` has doc_id, page, col, frag, gno, c, x0, y0, x1, y1, size, flags; `pages` has doc_id, page, width, height,
    split_x, top, bottom. Adds ord (by page, column and height), chunk (the page) and right, the bound of the column.
    """
    # what several steps read is written once: each plan stays short, and nothing is laid out twice
    built = layout.build_lines(glyphs.withColumn("icon", F.lit(False)), LINE)
    strokes = glyphs.groupBy(*LINE).agg(F.max(F.when((F.col("gno") < 3) & (F.col("flags").bitwiseAND(F.lit(16)) != 0), 1).otherwise(0)).alias("__bold"))
    built = settle(built.join(strokes, LINE).withColumn("bold", F.col("__bold") == 1).drop("__bold"))
    kept, _ = layout.drop_repeated(built, pages.select("doc_id", "page", "height", "top", "bottom"))
    place = Window.partitionBy("doc_id", "page").orderBy("col", "y0", "x0", "frag")
    kept = settle(kept)
    long = kept.withColumns({"glyphs": F.length(tx.compact("text")), "in_cell": F.lit(False), "crosses": F.lit(False)})
    bounds = layout.page_bounds(pages.select("doc_id", "page", "width", "split_x"), layout.col_bounds(long))
    placed = kept.withColumns({"ord": F.col("page").cast("long") * 1_000_000 + F.row_number().over(place), "chunk": F.col("page")})
    return placed.join(bounds.select("doc_id", "page", "col", "left", "right"), ["doc_id", "page", "col"], "left")


def structure_of(lines: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Sections, blocks, questions and answer entries of lines_of(): the lines with section, kind, number, part, passage_id.

    section is flow up to the first answer and answers from there on. part numbers the blocks of the flow (0: loose) and
    the entries of the answers. kind is guide or question for the first line of such a block, answer for that of an entry.
    """
    joined = settle(structure.join_heads(lines, conventions))
    answers = settle(structure.answer_start(joined, conventions))
    body = joined.groupBy("doc_id").agg(F.median("size").alias("body"))
    split = settle(joined.join(answers, "doc_id", "left").join(body, "doc_id").withColumn(
        "section", F.when(F.col("ord") >= F.col("answer_ord"), "answers").otherwise("flow")))
    flow = split.where("section = 'flow'")
    heads = structure.question_numbers(flow.withColumns({
        "box": F.lit(None).cast("int"), "digits_size": F.col("lead_size"), "next_size": F.col("size")}), conventions)
    candidates = settle(heads.where("number is not null").select("doc_id", "ord", "chunk", "number", (F.col("lead_size") >= 1.15 * F.col("body")).alias("big")))
    found = structure.scan_headers(candidates, answers.select("doc_id", "first_answer"))
    marked = flow.join(found.select("doc_id", "ord", "number"), ["doc_id", "ord"], "left")
    kind = F.when(F.col("number").isNotNull(), "question").when(tx.rx(F.col("text"), conventions.guide), "guide").otherwise("line")
    blocks = structure.segment(marked.withColumn("kind", kind)).withColumn("part", F.col("block"))
    full = structure.is_full(F.col("x1"), F.col("right"), F.col("size"))
    entries = structure.parse_answers(split.where("section = 'answers'").withColumn("full", F.coalesce(full, F.lit(False))), conventions)
    head = F.regexp_extract("text", conventions.answer_head, 1) != ""
    entries = entries.withColumns({"kind": F.when(head, "answer").otherwise("line"), "part": F.col("entry"), "passage_id": F.lit(None).cast("long")})
    names = [*lines.columns, "section", "kind", "number", "part", "passage_id"]
    return blocks.select(*names).unionByName(entries.select(*names))


def units_of(structured: DataFrame) -> DataFrame:
    """What is written for each part, in order: doc_id, section, part, ord, chunk, kind, number, text."""
    rows = structured.withColumn("emphasis_ends", F.lit(False))
    key = ["doc_id", "section", "part"]
    texts = structure.para_text(rows, structure.space_reliable(structured), key)
    first = structured.groupBy(*key).agg(F.min(F.struct("ord", "chunk", "kind", "number")).alias("f"))
    return first.join(texts, key).select(*key, "f.ord", "f.chunk", "f.kind", "f.number", "text")


def checks_of(lines: DataFrame, structured: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, coverage, missing, questions, answers, found, status, causes: an output held against what was read.

    `output` is units_of() or what a writer made of it: doc_id, ord, chunk, text.
    """
    source = lines.select(F.col("doc_id").alias("pair"), F.col("ord").alias("line_no"), "page", "text")
    written = output.select(F.col("doc_id").alias("pair"), "text")
    covered = quality.coverage_status(quality.coverage(source, written), quality.missing_lines(source, written)).select(
        F.col("pair").alias("doc_id"), "coverage", "missing", F.col("status").alias("covered"))
    questions = structured.where("kind = 'question'").select("doc_id", "ord", "chunk", "number")
    answers = structured.where("kind = 'answer'").select("doc_id", "ord", "number")
    order = quality.order_status(questions, output.select("doc_id", "ord", "chunk", "text"), answers).select("doc_id", "questions", "found", F.col("status").alias("ordered"))
    counted = answers.groupBy("doc_id").agg(F.countDistinct("number").alias("answers"))
    facts = settle(covered.join(order, "doc_id", "left").join(counted, "doc_id", "left").withColumns({
        "answers": F.coalesce("answers", F.lit(0)), "questions": F.coalesce("questions", F.lit(0)), "found": F.coalesce("found", F.lit(0)),
        "ordered": F.coalesce("ordered", F.lit("FAIL"))}))
    severity = {"PASS": 0, "WARN": 1, "FAIL": 2}

    def graded(column: str):
        return reduce(lambda expr, item: expr.when(F.col(column) == item[0], item[1]), severity.items(), F.when(F.lit(False), 0))

    differ = (F.col("answers") > 0) & (F.col("answers") != F.col("questions"))
    checks = [facts.select("doc_id", F.lit(1).alias("check_no"), graded("covered").alias("severity"), F.lit("text_coverage").alias("message")),
              facts.select("doc_id", F.lit(2).alias("check_no"), graded("ordered").alias("severity"), F.lit("question_order").alias("message")),
              facts.select("doc_id", F.lit(3).alias("check_no"), differ.cast("int").alias("severity"), F.lit("answer_count").alias("message"))]
    return facts.select("doc_id", "coverage", "missing", "questions", "answers", "found").join(quality.rollup(checks), "doc_id")


def convert(glyphs: DataFrame, pages: DataFrame, conventions: Conventions = KOREAN) -> dict[str, DataFrame]:
    """All stages of a conversion, by name: lines, structured, units, checks."""
    lines = settle(lines_of(glyphs, pages))
    structured = settle(structure_of(lines, conventions))
    units = settle(units_of(structured))
    return {"lines": lines, "structured": structured, "units": units, "checks": checks_of(lines, structured, units)}
