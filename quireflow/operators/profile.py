"""Profiling of inputs: text layer, title candidates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.conventions import KOREAN, SPACE, Conventions
from quireflow.functions import text as tx


def _count(column, pattern: str):
    return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))


def text_layer(pages: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """ok, garbled or scanned, by characters per page and the share of the expected script. `pages` has doc_id, text."""
    facts = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum(F.length(tx.strip("text"))).alias("chars"),
        F.sum(_count("text", f"[{conventions.script}]")).alias("script"), F.sum(_count("text", r"[\x{E000}-\x{F8FF}\x{FFFD}]")).alias("bad"))
    per_page = F.col("chars") / F.greatest(F.lit(1), "pages")
    status = F.when(per_page < 40, "scanned").when((F.col("script") < 0.2 * F.col("chars")) | (F.col("bad") > 0.05 * F.col("chars")), "garbled").otherwise("ok")
    return facts.select("doc_id", "pages", tx.half_even(per_page).cast("long").alias("chars_per_page"), status.alias("status"))


def title_candidates(texts: DataFrame, conventions: Conventions = KOREAN, n: int = 6) -> DataFrame:
    """Up to n title candidates per document among first-page header texts: big letters first, then long texts.

    Sizes combine per text before ranking, and the rank limit is applied before the shuffle of the ranking.
    """
    clean = texts.where("page = 1").select("doc_id", tx.collapse("text").alias("text"), "size")
    script = _count("text", f"[{conventions.script}]")
    solid = F.length(F.regexp_replace("text", rf"{SPACE}", ""))
    best = clean.where((F.length("text") >= 4) & (script >= F.greatest(F.lit(2.0), 0.3 * solid))).groupBy("doc_id", "text").agg(F.max("size").alias("size"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.rint("size")), F.desc(F.length("text")), "text")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def analyze(layer: DataFrame, titles: DataFrame, stats: DataFrame, sample: DataFrame) -> DataFrame:
    """One summary row per document; scanned documents carry the text layer only."""
    listed = titles.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), " | ").alias("titles"))
    out = layer.join(listed, "doc_id", "left").join(stats, "doc_id", "left").join(sample, "doc_id", "left")
    rest = [c for c in out.columns if c not in layer.columns]
    return out.select(*layer.columns, *[F.when(F.col("status") != "scanned", F.col(c)).alias(c) for c in rest])


def pick_title(texts: DataFrame) -> DataFrame:
    """Index of the title field (longest text, the later on ties) and of the first other field."""
    filled = texts.where(tx.strip("text") != "")
    title = filled.groupBy("doc_id").agg(F.max_by("i", F.struct(F.length(tx.strip("text")), F.col("i"))).alias("title"))
    others = filled.join(title, "doc_id").where("i <> title").groupBy("doc_id").agg(F.min("i").alias("next"))
    return title.join(others, "doc_id", "left")
