"""What leaves the library: structured documents, line dumps, reports, file names and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import scan
from quireflow.functions import text as tx
from quireflow.operators.usage import recent


def export_items(items: DataFrame) -> DataFrame:
    """Each item of a document as a JSON object; keys without a value are left out.

    `items` has doc_id, ord, type, number, qtype, passage, guide, stem, answer, choices ARRAY<STRING>.
    """
    filled = [F.col(c) for c in ("type", "number", "qtype", "passage", "guide", "stem", "answer")]
    choices = F.when(F.size("choices") > 0, F.col("choices")).alias("choices")
    return items.select("doc_id", "ord", F.to_json(F.struct(*filled, choices)).alias("json"))


def export_ir(items: DataFrame, warnings: DataFrame) -> DataFrame:
    """One JSON text per document: items in order and warnings. A document is one output record by definition."""
    listed = export_items(items).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda r: r["json"]), ",").alias("items"))
    notes = warnings.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list("warning"))).alias("warnings"))
    out = listed.join(notes, "doc_id", "left")
    return out.select("doc_id", F.concat(F.lit('{"items":['), "items", F.lit('],"warnings":'), F.coalesce("warnings", F.lit("[]")), F.lit("}")).alias("json"))


def export_lines(lines: DataFrame) -> DataFrame:
    """Debug dump of lines with coordinates to a tenth of a point."""
    return lines.select("doc_id", "page", "col", "ord", "box", *[tx.half_even(F.col(c), 1).alias(c) for c in ("x0", "x1", "y0")], "trailing_space", "text")


def batch_report(results: DataFrame) -> DataFrame:
    """One row per document: status, 'q (objective/subjective)', boxes found/expected, first causes and warnings.

    `results` has doc_id, status, questions, objective, boxes, expected, coverage, causes, warnings, error; a document with an
    error becomes an ERROR row.
    """
    text = lambda c: F.col(c).cast("string")
    return results.select(
        "doc_id", F.when(F.col("error").isNotNull(), "ERROR").otherwise(F.col("status")).alias("status"),
        F.concat(text("questions"), F.lit(" ("), text("objective"), F.lit("/"), (F.col("questions") - F.col("objective")).cast("string"), F.lit(")")).alias("questions"),
        F.concat(text("boxes"), F.lit("/"), text("expected")).alias("boxes"), "coverage", F.array_join(F.slice("causes", 1, 3), "; ").alias("causes"),
        F.array_join(F.slice("warnings", 1, 5), "; ").alias("warnings"))


def worst(report: DataFrame) -> DataFrame:
    """Exit level of a batch: 0 for PASS and WARN, 1 for FAIL, 2 for ERROR."""
    level = F.when(F.col("status") == "ERROR", 2).when(F.col("status") == "FAIL", 1).otherwise(0)
    return report.agg(F.coalesce(F.max(level), F.lit(0)).alias("worst"))


def usage_csv(usage: DataFrame, user: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the log export: local time, empty for nothing, detail as 'k=v k=v'; the newest `limit`, or all."""
    blank = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit(""))
    pairs = F.transform(F.map_entries(F.coalesce("detail", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return recent(usage, limit, user).select(
        "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "user", "label", blank("files").alias("files"), blank("pages").alias("pages"),
        blank("questions").alias("questions"), "status", blank("seconds").alias("seconds"), F.array_join(pairs, " ").alias("detail"))


def write_usage_csv(usage: DataFrame, path: str, user: str | None = None, limit: int = 5000) -> None:
    """Writes the newest `limit` rows of the log with header, as one file; the first header cell carries the byte order mark."""
    rows = usage_csv(usage, user, limit).drop("id").coalesce(1)
    rows.withColumnRenamed("time", "﻿time").write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Output names that collide with nothing: the name itself if free, else the first unused _runNN from 02.

    Taken numbers are counted per stem: the first gap is found among the n + 1 smallest numbers, so no list of all names is
    compared with all candidates. `wanted` has stem; `existing` has name.
    """
    number = F.regexp_extract("name", r"_run(\d{2,})$", 1)
    taken = existing.select(F.regexp_replace("name", r"_run\d{2,}$", "").alias("stem"), F.when(number == "", 1).otherwise(number.cast("int")).alias("n")).where("n >= 1").distinct()
    order = Window.partitionBy("stem").orderBy("n")
    gap = taken.withColumn("k", F.row_number().over(order)).groupBy("stem").agg(
        F.min(F.when(F.col("n") != F.col("k"), F.col("k"))).alias("gap"), F.max("k").alias("last"))
    free = F.coalesce("gap", F.col("last") + 1, F.lit(1))
    return wanted.join(gap, "stem", "left").select("stem", F.when(free == 1, F.col("stem")).otherwise(
        F.concat("stem", F.lit("_run"), F.when(free < 10, F.concat(F.lit("0"), free.cast("string"))).otherwise(free.cast("string")))).alias("name"))


def unique_names(files: DataFrame) -> DataFrame:
    """Member names of a bundle: stem, then 'stem (2)', 'stem (3)' in list order. `files` has bundle, ord, chunk, stem."""
    placed = scan.numbered(files, ["bundle", "stem"], ["chunk"], ["ord"], "n")
    return placed.withColumn("name", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".hwpx"))).drop("n")


def bundle_manifest(files: DataFrame) -> DataFrame:
    """Entries of a kept sample's bundle, numbered if there are several. Counts are joined, not windowed."""
    counts = files.groupBy("bundle").agg(F.count("*").alias("__n"))
    rows = files.join(counts, "bundle")
    no = F.when(F.col("ord") < 10, F.concat(F.lit("0"), F.col("ord").cast("string"))).otherwise(F.col("ord").cast("string"))
    return rows.withColumn("entry", F.when(F.col("__n") > 1, F.concat(no, F.lit("_"), "name")).otherwise(F.col("name"))).drop("__n")


def preview_text(lines: DataFrame, budget: int = 1800, limit: int = 2000) -> DataFrame:
    """Plain text of the first items of a document, up to the one that takes the line lengths over the budget.

    `lines` has doc_id, chunk, item, line, text. Lengths add up per item first; a running sum picks the items; only their
    few lines are put together.
    """
    per_item = lines.groupBy("doc_id", "chunk", "item").agg(F.sum(F.length("text")).alias("n"))
    upto = scan.running(per_item, ["doc_id"], ["chunk"], ["item"], sums={"__upto": F.col("n")})
    shown = upto.where(F.col("__upto") - F.col("n") <= budget).select("doc_id", "item")
    rows = lines.join(shown, ["doc_id", "item"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "line", "text"))), lambda r: r["text"]), "\r\n")
    return rows.groupBy("doc_id").agg(F.substring(joined, 1, limit).alias("preview"))


def sample(paras: DataFrame, n: int = 7) -> DataFrame:
    """First passage of a document: up to n paragraphs that are no pictures, and whether there are more.

    `paras` has doc_id, passage, ord, kind, text.
    """
    first = paras.groupBy("doc_id").agg(F.min("passage").alias("passage"))
    rows = paras.join(first, ["doc_id", "passage"])
    total = rows.groupBy("doc_id").agg(F.count("*").alias("all"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    shown = rows.where("kind <> 'image'").withColumn("no", F.row_number().over(order)).where(F.col("no") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda r: r["text"]), "\n")
    return total.join(shown.groupBy("doc_id").agg(F.count("*").alias("shown"), joined.alias("passage")), "doc_id", "left").select(
        "doc_id", F.coalesce("passage", F.lit("")).alias("passage"), (F.col("all") > F.coalesce("shown", F.lit(0))).alias("more"))


def sample_question(questions: DataFrame, choices: DataFrame) -> DataFrame:
    """First question of a document with its choices. `questions` has doc_id, ord, stem; `choices` doc_id, ord, choice_ord, text."""
    first = questions.groupBy("doc_id").agg(F.min(F.struct("ord", "stem")).alias("q")).select("doc_id", "q.ord", "q.stem")
    listed = choices.join(first.select("doc_id", "ord"), ["doc_id", "ord"]).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("choice_ord", "text"))), lambda r: r["text"]), "\n").alias("choices"))
    return first.join(listed, "doc_id", "left").select("doc_id", "stem", F.coalesce("choices", F.lit("")).alias("choices"))


def result_rows(jobs: DataFrame, checks: DataFrame, now: int) -> DataFrame:
    """Result of finished jobs: seconds the link stays open, and what the checks found."""
    return jobs.join(checks, "job").select(
        "job", F.greatest(F.lit(0), F.col("download_until") - F.lit(now)).alias("seconds_left"), "status", "questions", "answers",
        F.array_join(F.slice("warnings", 1, 5), "; ").alias("warnings"))
