"""What the session's settings do to plans."""

from pyspark.sql import functions as F

from quireflow.operators import structure
from quireflow.plans.structure_queries import text_lines
from quireflow.session import apply_settings, settle


def test_many_rows_in_a_small_file_do_not_pass_the_driver(spark):
    apply_settings(spark)
    few_bits = settle(spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k")))
    plan = spark.range(100_000_000).withColumnRenamed("id", "k").join(few_bits, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_dealt_by_page_are_not_dealt_again_by_line(spark):
    apply_settings(spark)
    lines = spark.range(1000).selectExpr("id % 50 AS doc_id", "id % 7 AS page", "id AS line").repartition(8, "doc_id", "page")
    counts = lines.groupBy("doc_id", "page", "line").count()
    plan = lines.hint("merge").join(counts, ["doc_id", "page", "line"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


def test_paragraphs_join_no_texts(spark, folder):
    apply_settings(spark)
    lines = text_lines(spark, folder).withColumns({"rx": F.col("x0") - F.col("left"), "frame": F.lit(None).cast("string"), "gap_below": F.lit(None).cast("double")})
    plan = structure.paragraphs(lines)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "pitch#" in plan
