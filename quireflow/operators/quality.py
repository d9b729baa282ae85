"""Checks of an output against its source, and integrity checks of the output itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.conventions import KOREAN, Conventions
from quireflow.functions import scan
from quireflow.functions import text as tx
from quireflow.operators import structure
from quireflow.session import settle

NGRAM = 6
PAIR_CHARS = 1 << 20  # of a pair's texts up to which one task takes the pair
TASK_CHARS = 1 << 19  # of the texts for one task, whose shingles then fit into its memory
BROADCAST = 500_000   # shingles at most that are sent to every task


def _shingle_rows(df: DataFrame, keys: list[str], numbers: bool) -> DataFrame:
    return df.select(*keys, F.explode(tx.shingles(tx.compact("text", numbers), NGRAM)).alias("shingle"))


def _by_size(*sides: DataFrame) -> list[tuple[DataFrame, ...]]:
    """The sides of ordinary pairs, dealt by pair, and those of pairs of over PAIR_CHARS characters as they come.

    Shingles are many times the text. Texts dealt by pair, TASK_CHARS a task, grow into shingles where they are grouped
    and joined, and no shingle is shuffled; those of a very long pair are, and so spread over many tasks.
    """
    chars = reduce(DataFrame.unionByName, [df.select("pair", F.length("text").alias("n")) for df in sides])
    sizes = settle(chars.groupBy("pair").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = settle(sizes.where(F.col("n") > PAIR_CHARS).select("pair"))
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_CHARS))
    ordinary = [df.join(large, "pair", "left_anti").repartition(tasks, "pair") for df in sides]
    return [tuple(ordinary), tuple(df.join(large, "pair", "left_semi") for df in sides)]


def coverage(source: DataFrame, output: DataFrame, numbers: bool = True) -> DataFrame:
    """Share of source shingles found in the output and the reverse, per pair, rounded to four places.

    `source` has pair, text (one row per line: no shingle crosses lines); `output` has pair, text (the whole text).
    Both sides become rows keyed by (pair, shingle) and meet in one aggregation; nothing is joined. Both are read more
    than once, so settled ones are best.
    """
    def sums(lines: DataFrame, texts: DataFrame) -> DataFrame:
        sides = [_shingle_rows(df.select("pair", "text", F.lit(1 - k).alias("s"), F.lit(k).alias("o")), ["pair", "s", "o"], numbers)
                 for k, df in enumerate((lines, texts))]
        each = sides[0].unionByName(sides[1]).groupBy("pair", "shingle").agg(F.max("s").alias("s"), F.max("o").alias("o"))
        return each.groupBy("pair").agg(F.sum("s").alias("src"), F.sum("o").alias("out"), F.sum(F.col("s") * F.col("o")).alias("both"))

    counted = reduce(DataFrame.unionByName, [sums(*part) for part in _by_size(source, output)])
    known = source.select("pair").distinct()
    one = F.lit(1)

    def share(total: str) -> Column:
        return tx.half_even(F.coalesce("both", F.lit(0)) / F.greatest(one, F.coalesce(total, F.lit(0))), 4)

    return known.join(counted, "pair", "left").select("pair", share("src").alias("coverage"), share("out").alias("precision"))


def missing_lines(source: DataFrame, output: DataFrame, numbers: bool = True) -> DataFrame:
    """Source lines of six or more compact characters with under half of their shingles in the output.

    `source` has pair, line_no, page, text. Texts dealt by pair meet where they are, in a hash table of the output's
    shingles for each task, so nothing is sorted; the session takes rows dealt by pair for rows dealt by pair and shingle.
    """
    def scored(lines: DataFrame, texts: DataFrame, hint: str) -> DataFrame:
        each = _shingle_rows(lines, ["pair", "line_no"], numbers).distinct()
        found = _shingle_rows(texts, ["pair"], numbers).distinct().withColumn("o", F.lit(1))
        met = each.join(found.hint(hint), ["pair", "shingle"], "left")
        return met.groupBy("pair", "line_no").agg((F.count("o") * 2 < F.count("*")).alias("missing"))

    ordinary, large = _by_size(source, output)
    lost = scored(*ordinary, "shuffle_hash").unionByName(scored(*large, "merge")).where("missing")
    # the line as it is shown is cut before it is shuffled
    named = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(": "), F.substring("text", 1, 40)).alias("line")
    return source.select("pair", "line_no", named).join(lost, ["pair", "line_no"]).select("pair", "line_no", "line")


def first_missing(missing: DataFrame, n: int = 30) -> DataFrame:
    """The first n missing lines of each pair (the report shows no more)."""
    order = Window.partitionBy("pair").orderBy("line_no")
    return missing.withColumn("no", F.row_number().over(order)).where(F.col("no") <= n)


def coverage_status(scores: DataFrame, missing: DataFrame) -> DataFrame:
    counts = missing.groupBy("pair").agg(F.count("*").alias("missing"))
    both = scores.join(counts, "pair", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return both.withColumn("status", F.when(F.col("coverage") < 0.97, "FAIL").when(
        (F.col("coverage") < 0.995) | (F.col("missing") > 0), "WARN").otherwise("PASS"))


def passage_coverage(items: DataFrame, outputs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All (item, output) pairs where at least `threshold` of the item's shingles occur in the output.

    `items` has item, text; `outputs` has pair, text. The items' shingles are sent to the outputs, which are dealt by pair
    as texts: they grow into shingles where these are looked up and counted by item, and no shingle is shuffled.
    """
    item_rows = settle(_shingle_rows(items, ["item"], True).distinct())
    wanted = item_rows.select("shingle").distinct()
    if item_rows.limit(BROADCAST + 1).count() <= BROADCAST:
        item_rows, wanted = F.broadcast(item_rows), F.broadcast(wanted)  # else all shingles of the outputs are shuffled to meet a few

    def counted(texts: DataFrame) -> DataFrame:
        found = _shingle_rows(texts, ["pair"], True).join(wanted, "shingle", "left_semi").distinct()
        return found.join(item_rows, "shingle").groupBy("pair", "item").agg(F.count("*").alias("hits"))

    hits = reduce(DataFrame.unionByName, [counted(*part) for part in _by_size(outputs)])
    sizes = item_rows.groupBy("item").agg(F.count("*").alias("n"))
    found = settle(hits.join(sizes, "item").where(F.col("hits") >= F.col("n") * threshold))
    return found.select("item", "pair", "hits", tx.half_even(F.col("hits") / F.col("n"), 4).alias("coverage"))


def order_status(numbers: DataFrame, paras: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """PASS if the numbers run without gap from the first one and the output shows all of them in order; else FAIL.

    `numbers` has doc_id, ord, chunk, number: the questions. `paras` has doc_id, ord, chunk, text: the paragraphs of the
    output, in one greedy pass of which `found` of the numbers first, first + 1, … head a paragraph ("3."). `answers`
    has doc_id. A document with neither questions nor answers is WARN, one with answers alone FAIL.
    """
    numbers = settle(numbers.select("doc_id", "chunk", "ord", "number"))
    shown = F.regexp_extract("text", r"^\s*([1-9][0-9]{0,8}|0)\s*\.", 1)
    paras = settle(paras.select("doc_id", "chunk", "ord", F.when(shown != "", shown).cast("int").alias("number")))
    # a chunk's first and last number stand for it, so no number is joined with its neighbour
    inside, across = Window.partitionBy("doc_id", "chunk").orderBy("ord"), Window.partitionBy("doc_id").orderBy("chunk")
    follows = lambda prev: prev.isNull() | (F.col("number") == prev + 1)
    chunks = numbers.withColumn("prev", F.lag("number").over(inside)).groupBy("doc_id", "chunk").agg(
        F.count("*").alias("n"), F.min_by("number", "ord").alias("number"), F.max_by("number", "ord").alias("last"), F.bool_and(follows(F.col("prev"))).alias("ok"))
    runs = settle(chunks.withColumn("before", F.lag("last").over(across)).groupBy("doc_id").agg(
        F.sum("n").alias("questions"), F.min_by("number", "chunk").alias("start"), F.bool_and(F.col("ok") & follows(F.col("before"))).alias("seq_ok")))
    heads = paras.where("number is not null").join(runs, "doc_id").where(
        (F.col("number") >= F.col("start")) & (F.col("number") < F.col("start") + F.col("questions")))
    chain = structure.number_chain(heads.select("doc_id", "ord", "chunk", "number"), runs.select("doc_id", "start"), {1: F.lit(True)})
    found = chain.groupBy("doc_id").agg(F.count("*").alias("found"))
    known = paras.select("doc_id").union(numbers.select("doc_id"))
    answered = None if answers is None else answers.select("doc_id").distinct().withColumn("answered", F.lit(True))
    docs = (known if answered is None else known.union(answered.select("doc_id"))).distinct().join(runs, "doc_id", "left").join(found, "doc_id", "left")
    docs = docs.withColumn("answered", F.lit(False)) if answered is None else docs.join(answered, "doc_id", "left")
    out = docs.select("doc_id", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("seq_ok", F.lit(True)).alias("seq_ok"),
                      F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("answered", F.lit(False)).alias("answered"))
    status = F.when((F.col("questions") == 0) & ~F.col("answered"), "WARN").when(
        (F.col("questions") > 0) & F.col("seq_ok") & (F.col("found") == F.col("questions")), "PASS").otherwise("FAIL")
    return out.withColumn("status", status).drop("answered")


def choice_counts(choices: DataFrame, keys: list[str]) -> DataFrame:
    """Questions whose choice count is not five, unless all parts are to be written."""
    out = choices.groupBy(*keys).agg(F.count("*").alias("choices"), F.bool_and("written").alias("written"))
    return out.where((F.col("choices") != 5) & ~F.col("written")).select(*keys, "choices")


def reconcile_counts(flow: DataFrame, notes: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Questions, parsed answers, answer heads in the source lines and planned notes side by side, with what disagrees."""
    head = tx.rx(F.col("text"), conventions.answer_head)
    counts = flow.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "question").alias("questions"), F.count_if(F.col("kind") == "answer").alias("answers"),
        F.count_if(head).alias("source_heads"))
    out = counts.join(notes, "doc_id", "left").withColumn("planned", F.coalesce("planned", F.lit(0)))
    return out.withColumns({
        "answers_differ": (F.col("answers") > 0) & (F.col("answers") != F.col("questions")),
        "heads_lost": (F.col("source_heads") > 0) & (F.col("answers") < F.col("source_heads")),
        "notes_differ": (F.col("planned") > 0) & (F.col("planned") != F.col("answers"))})


def doubled_numbers(notes: DataFrame) -> DataFrame:
    """Notes that still carry the printed number behind the generated one."""
    return notes.where(tx.rx(F.col("text"), rf"^\p{{Nd}}+\){tx.SPACE}*\p{{Nd}}{{1,3}}{tx.SPACE}*\)"))


def box_groups(paras: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Maximal runs of boxed paragraphs: first and last position, and whether an empty paragraph is missing behind.

    `paras` has doc_id, chunk, ord, text, boxed, pics. A run needs no spacer when a guide line stands before it, when
    nothing follows, or when an empty paragraph without picture follows.
    """
    around = scan.neighbours(
        paras, ["doc_id"], ["chunk"], ["ord"],
        lag={"prev_boxed": F.col("boxed"), "prev_text": F.col("text")},
        lead={"next_boxed": F.col("boxed"), "next_text": F.col("text"), "next_pics": F.col("pics")})
    opens = F.col("boxed") & ~F.coalesce("prev_boxed", F.lit(False))
    runs = scan.islands(around, ["doc_id"], ["chunk"], ["ord"], opens, "grp").where("boxed")
    guide = tx.rx(F.coalesce("prev_text", F.lit("")), conventions.guide)
    content = (tx.strip("next_text") != "") | (F.col("next_pics") > 0)
    closes = ~F.coalesce("next_boxed", F.lit(False))
    return runs.groupBy("doc_id", "grp").agg(
        F.min("ord").alias("first"), F.max("ord").alias("last"),
        F.bool_or(opens & guide).alias("after_guide"),
        F.bool_or(closes & F.coalesce(content, F.lit(False))).alias("tight"),
    ).select("doc_id", "grp", "first", "last", (~F.col("after_guide") & F.col("tight")).alias("no_spacer"))


def box_count_status(groups: DataFrame, expected: DataFrame) -> DataFrame:
    """Bordered groups found against those expected."""
    found = groups.groupBy("doc_id").agg(F.count("*").alias("found"))
    both = expected.join(found, "doc_id", "full").select(
        "doc_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("status", F.when(F.col("found") == F.col("expected"), "PASS").otherwise("FAIL"))


def spacer_missing(groups: DataFrame) -> DataFrame:
    return groups.groupBy("doc_id").agg(F.count_if("no_spacer").alias("missing"))


def dangling(refs: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """Ids used but not defined, each once with its number of uses: uses are counted before the join."""
    return refs.groupBy(key).agg(F.count("*").alias("uses")).join(defs.select(key).distinct(), key, "left_anti")


def unreferenced(defs: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Ids defined but never used."""
    return defs.select(key).distinct().join(refs.select(key).distinct(), key, "left_anti")


def count_mismatch(declared: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    both = declared.join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where(F.col("declared") != F.col("actual"))


def grid_errors(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables whose spanned cells do not cover rows × cols exactly once each; a table without any cell is all empty.

    `tables` has table_id, rows, cols, `cells` has table_id, row, col, rowspan, colspan. If every slot inside is covered
    once and none outside, the covered slots are rows × cols many, so counting replaces a join with the full grid.
    """
    slots = cells.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1))).withColumn(
        "c", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)))
    per_slot = slots.groupBy("table_id", "r", "c").agg(F.count("*").alias("n"))
    inside = F.coalesce((F.col("r") < F.col("rows")) & (F.col("c") < F.col("cols")), F.lit(False))
    there = F.col("r").isNotNull()
    out = tables.select("table_id", "rows", "cols").join(per_slot, "table_id", "left").groupBy("table_id", "rows", "cols").agg(
        F.count_if(F.col("n") > 1).alias("doubled"), F.count_if(there & ~inside).alias("outside"),
        F.count_if(inside).alias("covered"))
    out = out.withColumn("empty", F.col("rows") * F.col("cols") - F.col("covered"))
    return out.where((F.col("doubled") > 0) | (F.col("outside") > 0) | (F.col("empty") > 0)).select(
        "table_id", "doubled", "outside", "empty")


def auto_numbers(paras: DataFrame) -> DataFrame:
    """The number a paragraph shows: its numbering's start plus its position among those paragraphs."""
    placed = scan.numbered(paras, ["doc_id", "num_id"], ["chunk"], ["ord"], "no")
    return placed.withColumn("shown", (F.col("start") + F.col("no") - 1).cast("int")).drop("no")


def bad_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(~tx.rx(F.coalesce(F.col(column), F.lit("")), r"^[A-Z_]+$"))


def rollup(checks: list[DataFrame]) -> DataFrame:
    """Status per document: FAIL with any cause, else WARN with any warning, else PASS; causes keep check order.

    Each check has doc_id, check_no, severity (0 pass, 1 warn, 2 fail), message. A document has one row per check, so the
    ordered list holds as many entries as there are checks.
    """
    rows = reduce(DataFrame.unionByName, checks)
    causes = F.array_sort(F.collect_list(F.when(F.col("severity") == 2, F.struct("check_no", "message"))))
    out = rows.groupBy("doc_id").agg(F.max("severity").alias("worst"), causes.alias("causes"))
    return out.select("doc_id", F.when(F.col("worst") == 2, "FAIL").when(F.col("worst") == 1, "WARN").otherwise("PASS")
                      .alias("status"), F.array_join(F.transform("causes", lambda c: c["message"]), "; ").alias("causes"))


def package_checks(manifest: DataFrame) -> DataFrame:
    """Containers whose first member is not the stored type marker, or with members that do not parse."""
    return manifest.groupBy("package").agg(
        F.min_by(F.struct("name", "stored"), "ord").alias("first"), F.count_if(~F.col("parses")).alias("broken"),
    ).select("package", ((F.col("first.name") == "mimetype") & F.col("first.stored")).alias("first_ok"), "broken")


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one run that the other lacks, with multiplicity and side.

    Rows are compared through one aggregation over both runs instead of two EXCEPT ALL passes.
    """
    columns = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("__n").alias("extra")).where("extra <> 0").select(
        *columns, F.when(F.col("extra") > 0, "a").otherwise("b").alias("side"), F.abs("extra").alias("times"))


def source_lines(flow: DataFrame, box_items: DataFrame, cell_items: DataFrame) -> DataFrame:
    """All text lines of a document: of the flow, of boxes with their parts, and of table cells, nested tables included.

    flow: doc_id, kind, ref, text. box_items: doc_id, box, kind, ref, text. cell_items: doc_id, tbl, kind, ref, text.
    """
    out = ["doc_id", "text"]
    in_boxes = box_items.join(
        flow.where("kind = 'box'").select("doc_id", F.col("ref").alias("box")), ["doc_id", "box"], "left_semi")
    outer = flow.where("kind = 'table'").select("doc_id", F.col("ref").alias("tbl")).unionByName(
        in_boxes.where("kind = 'table'").select("doc_id", F.col("ref").alias("tbl")))
    in_cells = cell_items.join(outer, ["doc_id", "tbl"], "left_semi")
    inner = in_cells.where("kind = 'table'").select("doc_id", F.col("ref").alias("tbl"))
    nested = cell_items.join(inner, ["doc_id", "tbl"], "left_semi")
    parts = [part.where("kind = 'line'").select(*out) for part in (flow, in_boxes, in_cells, nested)]
    return reduce(DataFrame.unionAll, parts)
