"""Passages, questions, choices and answers out of ordered lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.conventions import CIRCLED, KOREAN, SPACE, Conventions
from quireflow.functions import graph, scan
from quireflow.functions import text as tx
from quireflow.session import settle

FLOW = ["doc_id"]
FOLD = 1024  # candidates of a document that are folded in one row


def next_numbers(candidates: DataFrame, jumps: dict[int, Column]) -> DataFrame:
    """For every candidate line, the first later line whose number is one more, or a jump of two or three more.

    `candidates` has doc_id, ord, chunk, number; `jumps` maps a distance to the condition the target line must meet.
    Each line asks for its wanted numbers; questions and lines of a (document, number) meet in one ordered scan that
    carries the nearest later line backwards. The scan works in chunks of the order, so a hot number is spread.
    """
    asks = candidates.select("doc_id", "ord", "chunk", F.explode(F.array(*[F.lit(d) for d in jumps])).alias("d"), "number")
    offers = candidates.select(
        "doc_id", "ord", "chunk", F.explode(F.array(*[F.when(cond, F.lit(d)) for d, cond in jumps.items()])).alias("d"), "number")
    rows = asks.select("doc_id", (F.col("number") + F.col("d")).alias("wanted"), "d", "chunk", "ord", F.lit(None).cast("int").alias("at"))
    rows = rows.unionByName(offers.where("d is not null").select(
        "doc_id", F.col("number").alias("wanted"), "d", "chunk", "ord", F.col("ord").alias("at")))
    # backwards: negated order, so that "last seen" is the nearest later line; an ask sorts before an offer at its own place
    rows = rows.withColumns({"back_chunk": -F.col("chunk"), "back": -F.col("ord"), "kind": F.when(F.col("at").isNull(), 0).otherwise(1)})
    seen = scan.running(rows, ["doc_id", "wanted", "d"], ["back_chunk"], ["back", "kind"], lasts={"nearest": F.col("at")})
    return seen.where("kind = 0").groupBy("doc_id", F.col("ord").alias("node")).agg(F.min("nearest").alias("nxt"))


def number_chain(candidates: DataFrame, starts: DataFrame, jumps: dict[int, Column]) -> DataFrame:
    """Lines accepted when numbers are expected one after the other.

    `starts` has doc_id, start. From start - 1 on, the next line whose number is one more (or a jump) is accepted. Documents
    of up to FOLD candidates walk them once; in longer ones the accepted lines are those reached along next-pointers.
    Returns doc_id, start, ord, number, prev (the number accepted before, start - 1 at first).
    """
    flags = {d: f"__d{d}" for d in jumps}
    rows = settle(candidates.select("doc_id", "chunk", "ord", "number", *[F.coalesce(cond, F.lit(False)).alias(flags[d]) for d, cond in jumps.items()]))
    long = settle(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select("doc_id"))
    if long.limit(1).count() == 0:
        return _walked(rows, starts, flags)
    starts = settle(starts.select("doc_id", "start"))
    short = _walked(rows.join(long, "doc_id", "left_anti"), starts, flags)
    return short.unionByName(_pointed(rows.join(long, "doc_id", "left_semi"), starts.join(long, "doc_id", "left_semi"), flags))


def _walked(rows: DataFrame, starts: DataFrame, flags: dict[int, str]) -> DataFrame:
    """number_chain of short documents, each folded over its candidates in order."""
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ord", "number", *flags.values()))).alias("items"))
    each = lists.join(starts.groupBy("doc_id").agg(F.collect_list(F.col("start").cast("int")).alias("starts")), "doc_id").select(
        "doc_id", "items", F.explode("starts").alias("start"))

    def advance(state: Column, e: Column) -> Column:
        fits = reduce(lambda a, b: a | b, [(e["number"] == state["last"] + d) & e[name] for d, name in flags.items()])
        hit = F.struct(e["ord"].alias("ord"), e["number"].alias("number"), state["last"].alias("prev"))
        return F.when(fits, F.struct(e["number"].alias("last"), F.concat(state["hits"], F.array(hit)).alias("hits"))).otherwise(state)

    types = dict(rows.dtypes)
    begin = F.struct((F.col("start") - 1).cast(types["number"]).alias("last"),
                     F.array().cast(f"array<struct<ord:{types['ord']},number:{types['number']},prev:{types['number']}>>").alias("hits"))
    return each.select("doc_id", "start", F.explode(F.aggregate("items", begin, advance)["hits"]).alias("h")).select("doc_id", "start", "h.*")


def _pointed(rows: DataFrame, starts: DataFrame, flags: dict[int, str]) -> DataFrame:
    """number_chain of long documents. A virtual line before the document, numbered start - 1, opens each chain."""
    roots = starts.select("doc_id", F.lit(-1).alias("chunk"), (-F.col("start") - 1).cast("int").alias("ord"),
                          (F.col("start") - 1).cast("int").alias("number"), *[F.lit(False).alias(name) for name in flags.values()])
    pointers = next_numbers(rows.unionByName(roots), {d: F.col(name) for d, name in flags.items()})
    reached = graph.follow_chain(
        _scoped(pointers, starts), starts.select("doc_id", "start", (-F.col("start") - 1).cast("int").alias("node")), ["doc_id", "start"])
    lines = rows.select("doc_id", F.col("ord").alias("node"), "number")
    chain = reached.join(lines, ["doc_id", "node"]).select("doc_id", "start", F.col("node").alias("ord"), "number")
    # numbers rise along the chain, so ordering by number is ordering by place
    steps = scan.neighbours(chain.withColumn("chunk", F.floor(F.col("number") / 1024)), [*FLOW, "start"], ["chunk"], ["number"], lag={"prev": F.col("number")})
    return steps.select("doc_id", F.col("start").cast("int").alias("start"), "ord", "number", F.coalesce("prev", F.col("start") - 1).cast(dict(rows.dtypes)["number"]).alias("prev"))


def _scoped(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    return pointers.join(starts.select("doc_id", "start"), "doc_id")


def found_in_order(numbers: DataFrame) -> DataFrame:
    """How many of first, first + 1, … appear one after the other: doc_id, found."""
    first = numbers.groupBy("doc_id").agg(F.min_by("number", F.struct("chunk", "ord")).alias("start"))
    chain = number_chain(numbers, first, {1: F.lit(True)})
    return chain.groupBy("doc_id").agg(F.count("*").alias("found"))


def join_heads(lines: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Joins an answer number standing alone with the answer line right below it.

    `lines` has doc_id, chunk, ord, page, col, text, x0, y0, size.
    """
    beside = scan.neighbours(
        lines, FLOW, ["chunk"], ["ord"],
        lag={f"p_{c}": F.col(c) for c in ("text", "page", "col", "x0", "y0")},
        lead={f"n_{c}": F.col(c) for c in ("text", "page", "col", "x0", "y0", "size")})

    def pair(above: dict[str, Column], below: dict[str, Column]) -> Column:
        dy = below["y0"] - above["y0"]
        return F.coalesce(
            tx.rx(above["text"], conventions.answer_number) & tx.rx(below["text"], conventions.answer_tag)
            & (above["page"] == below["page"]) & (above["col"] == below["col"])
            & (F.abs(below["x0"] - above["x0"]) < 2 * below["size"]) & (dy >= 0) & (dy < 3 * below["size"]), F.lit(False))

    names = ("text", "page", "col", "x0", "y0", "size")
    own = {c: F.col(c) for c in names}
    joins = pair({c: F.col(f"p_{c}") for c in names if c != "size"}, own)
    goes = pair(own, {c: F.col(f"n_{c}") for c in names})
    out = beside.withColumns({"__joins": joins, "__goes": goes}).where(~F.col("__goes"))
    return out.withColumns({
        "text": F.when(F.col("__joins"), F.concat_ws(" ", "p_text", "text")).otherwise(F.col("text")),
        "x0": F.when(F.col("__joins"), F.least("p_x0", "x0")).otherwise(F.col("x0")),
        "y0": F.when(F.col("__joins"), F.col("p_y0")).otherwise(F.col("y0"))}).select(*lines.columns)


def question_numbers(lines: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Number of a line that looks like a question head, else null.

    `lines` has text, box, lead_size, body, bold (among the first three glyphs), digits_size, next_size.
    """
    dotted = F.regexp_extract("text", conventions.question_number, 1)
    bare = F.regexp_extract("text", conventions.question_bare, 1)
    big = F.col("lead_size") >= 1.15 * F.col("body")
    number = F.when(F.col("box").isNotNull(), None).when(dotted != "", F.when(big | F.col("bold"), dotted)).when(
        (bare != "") & big & (F.col("digits_size") >= 1.15 * F.col("next_size")), bare)
    return lines.withColumn("number", number.cast("int"))


def answer_start(lines: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """First line of the smallest answer number of each document, in one aggregation."""
    number = F.regexp_extract("text", conventions.answer_head, 1)
    heads = lines.where(number != "").select("doc_id", number.cast("int").alias("number"), "ord")
    return heads.groupBy("doc_id").agg(F.min(F.struct("number", "ord")).alias("m")).select(
        "doc_id", F.col("m.number").alias("first_answer"), F.col("m.ord").alias("answer_ord"))


def scan_headers(candidates: DataFrame, first_answers: DataFrame | None = None, faithful: DataFrame | None = None) -> DataFrame:
    """Question heads found by expecting one number after the other, allowing a big-lettered jump of one or two.

    Tried from the first answer number, from 1 and from the first candidate; the longest run wins, the earlier start on
    ties. Documents that follow source pages keep nothing if under half of their candidates were hit. `candidates` has
    doc_id, ord, chunk, number, big. Returns doc_id, ord, number, skipped.
    """
    candidates = settle(candidates)
    docs = candidates.groupBy("doc_id").agg(F.min_by("number", F.struct("chunk", "ord")).alias("start"), F.count("*").alias("heads"))
    docs = settle(docs if faithful is None else docs.join(faithful, "doc_id", "left"))
    tries = [docs.select("doc_id", F.lit(1).alias("rank"), F.lit(1).alias("start")), docs.select("doc_id", F.lit(2).alias("rank"), "start")]
    if first_answers is not None:
        tries.append(first_answers.select("doc_id", F.lit(0).alias("rank"), F.col("first_answer").alias("start")))
    starts = reduce(DataFrame.unionByName, tries).groupBy("doc_id", "start").agg(F.min("rank").alias("rank"))
    chain = number_chain(candidates, starts, {1: F.lit(True), 2: F.col("big"), 3: F.col("big")})
    sizes = chain.groupBy("doc_id", "start").agg(F.count("*").alias("n")).join(starts, ["doc_id", "start"])
    best = sizes.groupBy("doc_id").agg(F.max_by(F.struct("start", "n"), F.struct("n", -F.col("rank"))).alias("b"))
    if faithful is not None:
        best = best.join(docs, "doc_id").where(~F.coalesce("faithful", F.lit(False)) | (F.col("b.n") >= 0.5 * F.col("heads")))
    kept = chain.join(best.select("doc_id", F.col("b.start").alias("__best")), "doc_id").where("start = __best")
    return kept.select("doc_id", "ord", "number", (F.col("number") - F.col("prev") - 1).alias("skipped"))


def label_icons(leads: DataFrame, scope: list[str]) -> DataFrame:
    """Majority vote on which choice digit an icon image is, by its place among the first ten of each question.

    `leads` has scope + (question, ord, digest). Ties go to the place seen first.
    """
    place = Window.partitionBy(*scope, "question").orderBy("ord")
    votes = leads.withColumn("k", F.row_number().over(place)).where("k <= 10")
    return _voted(votes.withColumn("seen", F.struct("question", "ord")), scope)


def _voted(votes: DataFrame, scope: list[str]) -> DataFrame:
    counts = votes.groupBy(*scope, "digest", "k").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    # smallest struct wins: most votes, then earliest sight
    return counts.groupBy(*scope, "digest").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "k")).alias("m")).select(
        *scope, "digest", F.element_at(F.array(*[F.lit(c) for c in CIRCLED]), F.col("m.k")).alias("label"), (-F.col("m.n")).alias("votes"))


def icon_runs(leads: DataFrame) -> DataFrame:
    """Icons at line starts as sets of choices, for documents without question heads: adds run and k, the place in it.

    `leads` has doc_id, ord, chunk, page, col, x0, digest. A run goes on while page, column and x (to three points) stay the
    same and no icon comes twice. The next start behind a start s is the first place whose icon has stood at s or later,
    so it is the smallest "next place of the same icon" over all places from s on: a running minimum from behind. The
    starts that count are those on the way along these pointers from where the place on the page changes.
    """
    spot = F.struct("page", "col", F.rint(F.col("x0") / 3).alias("x"))
    rows = leads.withColumn("spot", spot)
    rows = scan.neighbours(rows, FLOW, ["chunk"], ["ord"], lag={"p_spot": F.col("spot")})
    rows = settle(scan.islands(rows, FLOW, ["chunk"], ["ord"], ~F.col("p_spot").eqNullSafe(F.col("spot")), "stretch"))
    again = scan.neighbours(rows, [*FLOW, "stretch", "digest"], ["chunk"], ["ord"], lead={"again": F.col("ord")})
    back = again.withColumns({"back_chunk": -F.col("chunk"), "back": -F.col("ord")})
    ahead = scan.running(back, [*FLOW, "stretch"], ["back_chunk"], ["back"], maxes={"__next": -F.col("again")})
    pointers = ahead.select("doc_id", F.col("ord").alias("node"), (-F.col("__next")).alias("nxt"))
    first = rows.groupBy("doc_id", "stretch").agg(F.min("ord").alias("node")).select("doc_id", "node")
    starts = graph.follow_chain(pointers, first, FLOW).select("doc_id", F.col("node").alias("ord")).withColumn("starts", F.lit(True))
    marked = rows.join(starts, ["doc_id", "ord"], "left")
    runs = scan.islands(marked, FLOW, ["chunk"], ["ord"], F.col("starts"), "run")
    return scan.numbered(runs, [*FLOW, "run"], ["chunk"], ["ord"], "k").select(*leads.columns, "run", F.col("k").cast("int").alias("k"))


def label_icons_unheaded(leads: DataFrame) -> DataFrame:
    """label_icons() for documents without question heads: runs of three or more icons vote. `leads` as for icon_runs()."""
    runs = settle(icon_runs(leads))
    long = runs.groupBy("doc_id", "run").agg(F.count("*").alias("n")).where("n >= 3").select("doc_id", "run")
    votes = runs.where("k <= 10").join(long, ["doc_id", "run"])
    return _voted(votes.withColumn("seen", F.col("ord")), FLOW)


def nearest_label(samples: DataFrame, prototypes: DataFrame, scope: list[str], limit: float) -> DataFrame:
    """Label of the closest prototype by mean squared error, or null beyond the limit.

    A scope has at most one prototype per choice digit, so its prototypes travel as one short array and every sample
    meets them in a single row; there is no pair table.
    """
    packed = prototypes.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("label", "vector"))).alias("__protos"))
    error = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
    scored = F.array_min(F.transform("__protos", lambda p: F.struct(error(F.col("vector"), p["vector"]).alias("mse"), p["label"].alias("label"))))
    out = samples.join(packed, scope, "left").withColumn("__best", scored)
    return out.withColumns({"mse": F.col("__best.mse"), "nearest": F.when(F.col("__best.mse") < limit, F.col("__best.label"))}).drop(
        "__best", "__protos")


def segment(lines: DataFrame) -> DataFrame:
    """Blocks opened by guide lines and question heads; a question keeps the passage opened before it.

    `lines` has doc_id, chunk, ord, kind (guide, question or other). Lines before the first opener are loose (block 0).
    """
    guide, question = F.col("kind") == "guide", F.col("kind") == "question"
    marked = scan.running(lines, FLOW, ["chunk"], ["ord"],
                          sums={"block": (guide | question).cast("long"), "passage_id": guide.cast("long")},
                          lasts={"block_kind": F.when(guide | question, F.col("kind"))})
    return marked.withColumn("block_kind", F.coalesce("block_kind", F.lit("loose")))


def loose_notes(items: DataFrame) -> DataFrame:
    """Note text of loose items, and whether an item is the first of its source page."""
    placed = scan.neighbours(items, FLOW, ["page"], ["ord"], lag={"prev_page": F.col("page")})
    note = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(": "), F.substring(F.coalesce("text", F.lit("[그림/박스]")), 1, 30))
    return placed.withColumns({"top": F.col("prev_page").isNull() | (F.col("prev_page") != F.col("page")), "note": note}).drop("prev_page")


def is_full(x1: Column, right: Column, size: Column) -> Column:
    return x1 >= right - F.greatest(1.2 * size, F.lit(6.0))


def space_reliable(lines: DataFrame) -> DataFrame:
    """Whether the text layer keeps line-end spaces: at least 5 % of full lines have one."""
    full = is_full(F.col("x1"), F.col("right"), F.col("size"))
    counts = lines.groupBy("doc_id").agg(F.count_if(full).alias("full"), F.count_if(full & F.col("trailing_space")).alias("spaced"))
    return counts.select("doc_id", "full", (F.coalesce(F.col("spaced") >= 0.05 * F.col("full"), F.lit(False)) & (F.col("full") > 0)).alias("reliable"))


def line_tests(lines: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """What paragraphs() and stanza_breaks() ask of a line and the one before it, without their texts; written once for both."""
    same = (F.col("p_page") == F.col("page")) & (F.col("p_col") == F.col("col"))
    pitched = scan.neighbours(
        lines, FLOW, ["page"], ["ord"],
        lag={f"p_{c}": F.col(c) for c in ("page", "col", "y0", "x1", "size", "right", "text", "frame", "gap_below")})
    pitched = pitched.withColumns({"same": F.coalesce(same, F.lit(False)), "dy": F.col("y0") - F.col("p_y0")})
    text, before = F.col("text"), F.col("p_text")
    joins = F.col("same") & (F.abs("dy") < 0.4 * F.col("p_size")) & tx.rx(tx.strip("text"), r"^\(.{0,6}\)$")
    p_full = is_full(F.col("p_x1"), F.col("p_right"), F.col("p_size"))
    asked = tx.rx(F.regexp_replace(text, "^[ ✓✔√]+", ""), conventions.marker) & tx.rx(before, rf"[?？]{SPACE}*$")
    label = tx.rx(text, conventions.label) | tx.rx(before, conventions.label)
    sure = ~p_full | asked | label | (F.coalesce("frame", F.lit("")) != F.coalesce("p_frame", F.lit("")))
    # the tests that read text come first: what is joined and dealt by page from here on is a few numbers a line
    return settle(pitched.select(
        "doc_id", "page", "ord", "rx", "size", "p_size", "same", "dy", "p_gap_below", joins.alias("may_join"), sure.alias("sure"), p_full.alias("was_full"), before.isNull().alias("first"),
        tx.rx(text, conventions.marker).alias("marker"), tx.rx(text, rf"^{SPACE}*\p{{Nd}}{{1,2}}{SPACE}?\.{SPACE}").alias("numbered")))


def paragraphs(lines: DataFrame, conventions: Conventions = KOREAN, tested: DataFrame | None = None) -> DataFrame:
    """Numbers the paragraphs of each document.

    `lines` has doc_id, ord, page, col, text, rx (offset from the left bound), x1, right, y0, size, frame, gap_below (room
    left in the box below a line, null outside boxes). Tests against the previous line alone end a paragraph for sure, so
    they cut the document into short pieces; the tests that look at the first and second line of the open paragraph are
    folded inside a piece. A piece is an unbroken run of full lines. The pitch is the median step to the line below, or one
    and a half times the median size where no line follows another. `tested` is line_tests() of the lines, if it is there.
    """
    tested = line_tests(lines, conventions) if tested is None else tested
    step = F.when(F.col("same") & (F.col("dy") > 0) & (F.col("dy") < 3.5 * F.col("p_size")), F.col("dy"))
    pitch = tested.groupBy("doc_id").agg(F.coalesce(F.median(step), 1.5 * F.median("size")).alias("pitch"))
    rows = tested.join(tested.select("doc_id", "page").distinct().join(pitch, "doc_id"), ["doc_id", "page"])
    cross = ~F.col("same") & (F.col("p_gap_below") > 1.25 * F.col("pitch"))
    sure = ~F.col("may_join") & (F.col("sure") | F.coalesce(cross, F.lit(False)) | (F.col("same") & (F.col("dy") > 1.3 * F.col("pitch")) & (F.col("dy") > 3 * F.col("size"))))
    rows = rows.withColumns({"joins": F.coalesce("may_join", F.lit(False)), "p_full": F.coalesce("was_full", F.lit(False)),
                             "opens": F.col("first") | F.coalesce(sure, F.lit(False))})
    pieces = scan.islands(rows, FLOW, ["page"], ["ord"], F.col("opens"), "piece")
    item = F.struct("ord", "page", "rx", "size", "p_size", "same", "dy", "pitch", "marker", "joins", "p_full", "numbered")
    lists = pieces.groupBy("doc_id", "piece").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def advance(state: Column, e: Column) -> Column:
        offset = e["rx"] - state["first_rx"]
        hang = (e["same"] & state["first_no"] & e["p_full"] & (offset >= 0.8 * e["size"]) & (offset <= 3 * e["size"])
                & (e["dy"] > 0) & (e["dy"] <= 3 * e["size"])
                & ((state["n"] == 1) | (F.abs(e["rx"] - state["second_rx"]) < 0.4 * e["size"])))
        slack = F.when(e["same"], 0.4).otherwise(1.0) * e["size"]
        breaks = ~e["joins"] & (
            (e["same"] & (e["dy"] > 1.3 * e["pitch"]) & ~hang) | (e["marker"] & (e["rx"] <= state["first_rx"] + 0.4 * e["size"]))
            | ((F.abs(e["size"] - e["p_size"]) > 0.15 * F.greatest(e["size"], e["p_size"])) & ~hang)
            | ((state["n"] >= 2) & (e["rx"] > state["second_rx"] + slack)))
        starts = breaks | (state["n"] == 0)
        return F.struct(
            F.when(starts, e["rx"]).otherwise(state["first_rx"]).alias("first_rx"),
            F.when(starts, e["numbered"]).otherwise(state["first_no"]).alias("first_no"),
            F.when(starts, e["rx"]).when(state["n"] == 1, e["rx"]).otherwise(state["second_rx"]).alias("second_rx"),
            F.when(starts, 1).otherwise(state["n"] + 1).alias("n"),
            F.when(starts, F.concat(state["starts"], F.array(F.struct(e["page"].alias("page"), e["ord"].alias("ord"))))).otherwise(state["starts"]).alias("starts"))

    begin = F.struct(F.lit(0.0).alias("first_rx"), F.lit(False).alias("first_no"), F.lit(0.0).alias("second_rx"),
                     F.lit(0).alias("n"), F.array().cast("array<struct<{}>>".format(",".join(f"{c}:{dict(lines.dtypes)[c]}" for c in ("page", "ord")))).alias("starts"))
    folded = F.aggregate("items", begin, advance)["starts"]
    started = lists.select("doc_id", F.explode(folded).alias("s")).select("doc_id", "s.page", "s.ord").withColumn("starts", F.lit(True))
    numbered = tested.select("doc_id", "page", "ord").join(started, ["doc_id", "page", "ord"], "left")
    return scan.islands(numbered, FLOW, ["page"], ["ord"], F.col("starts"), "para").select("doc_id", "ord", "para")


def stanza_breaks(lines: DataFrame, paras: DataFrame, conventions: Conventions = KOREAN, tested: DataFrame | None = None) -> DataFrame:
    """Lines in front of which a blank paragraph stands: doc_id, ord.

    `paras` is paragraphs() of `lines`. A paragraph that starts over 1.7 pitches below the line before it opens a stanza,
    unless it would have been the hanging second line of a numbered paragraph; so does one in another column or page if
    the box before it had room for more than a line. `tested` is line_tests() of the lines, if it is there.
    """
    rows = (line_tests(lines, conventions) if tested is None else tested).select(
        "doc_id", "ord", "rx", "size", "p_size", "same", "dy", "p_gap_below", F.coalesce("was_full", F.lit(False)).alias("p_full"), F.col("numbered").alias("starts_no"))
    step = F.when(F.col("same") & (F.col("dy") > 0) & (F.col("dy") < 3.5 * F.col("p_size")), F.col("dy"))
    pitch = rows.groupBy("doc_id").agg(F.coalesce(F.median(step), 1.5 * F.median("size")).alias("pitch"))
    rows = settle(rows.join(paras, ["doc_id", "ord"]))
    line = F.struct("ord", "rx", "starts_no", "size", "same", "dy", "p_full", "p_gap_below")
    first = settle(rows.groupBy("doc_id", "para").agg(F.min(line).alias("f"), F.count("*").alias("n")))
    second = rows.join(first.select("doc_id", "para", F.col("f.ord").alias("first")), ["doc_id", "para"]).where("ord > first").groupBy("doc_id", "para").agg(F.min_by("rx", "ord").alias("second_rx"))
    before = first.join(second, ["doc_id", "para"], "left").select(
        "doc_id", (F.col("para") + 1).alias("para"), F.col("f.rx").alias("first_rx"), F.col("f.starts_no").alias("numbered"), F.col("n").alias("b_n"), "second_rx")
    starts = first.select("doc_id", "para", "f.*").join(before, ["doc_id", "para"]).join(pitch, "doc_id")
    offset = F.col("rx") - F.col("first_rx")
    hang = (F.col("numbered") & F.col("p_full") & (offset >= 0.8 * F.col("size")) & (offset <= 3 * F.col("size"))
            & (F.col("dy") > 0) & (F.col("dy") <= 3 * F.col("size")) & ((F.col("b_n") == 1) | (F.abs(F.col("rx") - F.col("second_rx")) < 0.4 * F.col("size"))))
    blank = F.when(F.col("same"), (F.col("dy") > 1.7 * F.col("pitch")) & ~hang).otherwise(F.coalesce(F.col("p_gap_below") > 1.25 * F.col("pitch"), F.lit(False)))
    return starts.where(blank).select("doc_id", "ord")


def bracket_groups(lines: DataFrame) -> DataFrame:
    """Runs of consecutive lines of one bracket, named by the bracket's label line.

    `lines` has doc_id, chunk, ord, bracket, bracket_label, text.
    """
    labels = lines.where("bracket_label").groupBy("doc_id", "bracket").agg(
        F.max_by(tx.strip("text"), F.struct("chunk", "ord")).alias("label"))
    rest = lines.where(~F.col("bracket_label"))
    beside = scan.neighbours(rest, FLOW, ["chunk"], ["ord"], lag={"p_bracket": F.col("bracket")})
    runs = scan.islands(beside, FLOW, ["chunk"], ["ord"], ~F.col("p_bracket").eqNullSafe(F.col("bracket")), "run")
    return runs.where(F.col("bracket").isNotNull()).join(labels, ["doc_id", "bracket"]).groupBy(
        "doc_id", "bracket", "run", "label").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("lines"))


def ordered_concat(order: list[str], text: Column, separator: str = "") -> Column:
    """Concatenation of a group's texts in order. The group must be one paragraph or line."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("__t"))))
    return F.array_join(F.transform(rows, lambda r: r["__t"]), separator)


def para_text(lines: DataFrame, reliable: DataFrame, para: list[str]) -> DataFrame:
    """Text of a paragraph: a space between two lines if the first kept one, or the layer keeps none, or emphasis ends.

    Where lines have page, col, x0, x1, y0 and size, a piece further right on the row of the line before it has one too.
    """
    order = Window.partitionBy(*para).orderBy("ord")
    rows = lines.join(reliable.select("doc_id", "reliable"), "doc_id", "left").withColumn("__space", F.lag("trailing_space").over(order))
    spaced = F.coalesce("__space", F.lit(False)) | ~F.coalesce("reliable", F.lit(False)) | F.coalesce("emphasis_ends", F.lit(False))
    place = ("page", "col", "x1", "y0", "size")
    if {*place, "x0"} <= set(lines.columns):
        rows = rows.withColumns({f"__p_{c}": F.lag(c).over(order) for c in place})
        beside = ((F.col("__p_page") == F.col("page")) & (F.col("__p_col") == F.col("col")) & (F.abs(F.col("y0") - F.col("__p_y0")) < 0.4 * F.col("__p_size")) & (F.col("x0") > F.col("__p_x1")))
        spaced = spaced | F.coalesce(beside, F.lit(False))
    piece = F.when(F.col("__space").isNull(), F.col("text")).when(spaced, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    return rows.groupBy(*para).agg(ordered_concat(["ord"], piece).alias("text"))


def runs(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """Glyphs of a line as runs of one look; a space takes the weight, colour and size of the run before it.

    `glyphs` has line keys + (gno, c, underline, bold, color, size).
    """
    order = Window.partitionBy(*line).orderBy("gno")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    look = F.struct("bold", F.coalesce("color", F.lit("")).alias("color"), (F.rint(F.col("size") * 2) / 2).alias("size"))
    solid = F.when(F.col("c") != " ", look)
    rows = glyphs.withColumn("__look", F.coalesce(F.last(solid, ignorenulls=True).over(upto), look))
    changed = (F.lag("__look").over(order) != F.col("__look")) | (F.lag("underline").over(order) != F.col("underline"))
    rows = rows.withColumn("run", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(upto))
    return rows.groupBy(*line, "run").agg(
        ordered_concat(["gno"], F.col("c")).alias("text"), F.first("underline").alias("underline"), F.first("__look").alias("look")
    ).select(*line, "run", "text", "underline", "look.bold", "look.color", "look.size")


def para_layout(lines: DataFrame, para: list[str]) -> DataFrame:
    """Alignment, role, indent and line pitch of paragraphs.

    `lines` has para keys + (ord, text, x0, x1, y0, size, left, right).
    """
    order = Window.partitionBy(*para).orderBy("ord")
    rows = lines.withColumns({"__no": F.row_number().over(order), "__dy": F.col("y0") - F.lag("y0").over(order)})
    tol = F.greatest(1.2 * F.col("size"), F.lit(6.0))

    def nth(column: str, n: int) -> Column:
        return F.max(F.when(F.col("__no") == n, F.col(column)))

    g = rows.groupBy(*para).agg(
        F.count("*").alias("n"), F.bool_and(F.col("x1") >= F.col("right") - tol).alias("at_right"),
        *[nth(c, 1).alias(f"f_{c}") for c in ("x0", "x1", "size", "left", "right", "text")],
        (nth("x0", 1) - nth("left", 1) - nth("x0", 2) + nth("left", 2)).alias("hang"),
        F.median(F.when(F.col("__dy") > 0, F.col("__dy"))).alias("pitch"), F.median("size").alias("size"))
    width = F.greatest(F.lit(1.0), F.col("f_right") - F.col("f_left"))
    right = (F.col("n") <= 2) & F.col("at_right") & (F.col("f_x0") > F.col("f_left") + 0.3 * width)
    margins = F.abs((F.col("f_x0") - F.col("f_left")) - (F.col("f_right") - F.col("f_x1")))
    centre = (F.col("n") == 1) & (margins < 0.04 * width) & (F.col("f_x0") > F.col("f_left") + 0.15 * width)
    align = F.when(right, "RIGHT").when(centre, "CENTER").otherwise("LEFT")
    start = F.col("f_x0") - F.col("f_left")
    indent = F.when(right | centre, 0.0).when(F.col("n") >= 2, tx.half_even(F.col("hang"), 1)).otherwise(
        F.when(start > 0.4 * F.col("f_size"), tx.half_even(start, 1)).otherwise(0.0))
    return g.select(*para, align.alias("align"),
                    F.when(right & tx.rx(F.col("f_text"), rf"^{SPACE}*[-–—]"), "credit").otherwise("").alias("role"),
                    indent.alias("indent"), F.coalesce(tx.half_even(F.col("pitch") / F.col("size") * 100), F.lit(0.0)).cast("int").alias("line_pct"))


def glyph_runs(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """Glyphs of a line as runs of one look: weight, colour, size to half points, shade and box, and underline.

    `glyphs` has line keys + (gno, c, underline, bold, color, size, icon, shade, boxed). An icon has the size 0. A space looks like
    the letter before it, but is shaded or boxed only if it is so itself, and all spaces between it and that letter are.
    A space at the start of the line stands for a letter.
    """
    order = Window.partitionBy(*line).orderBy("gno")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    letter = ~tx.is_space(F.col("c")) | (F.row_number().over(order) == 1)
    rows = glyphs.withColumn("__letter", letter).withColumn("__at", F.sum(F.col("__letter").cast("int")).over(upto))
    half = F.when(F.col("icon"), 0.0).otherwise(F.rint(F.col("size") * 2) / 2)
    own = F.struct("bold", "color", half.alias("size"), "shade", "boxed")
    since = Window.partitionBy(*line, "__at").orderBy("gno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when(F.col("__letter"), own), ignorenulls=True).over(since)
    held = rows.withColumns({"__first": first, "__shaded": F.min(F.when(F.col("__letter"), True).otherwise(F.col("shade").isNotNull())).over(since),
                             "__boxed": F.min(F.when(F.col("__letter"), True).otherwise(F.col("boxed"))).over(since)})
    look = F.struct("__first.bold", "__first.color", "__first.size", F.when(F.col("__shaded"), F.col("__first.shade")).alias("shade"), (F.col("__first.boxed") & F.col("__boxed")).alias("boxed"), "underline")
    held = held.withColumn("__look", look)
    changed = ~F.col("__look").eqNullSafe(F.lag("__look").over(order))
    held = held.withColumn("run", F.sum(changed.cast("int")).over(upto))
    return held.groupBy(*line, "run").agg(ordered_concat(["gno"], F.col("c")).alias("text"), F.first("__look").alias("look")).select(*line, "run", "text", "look.*")


DEFAULT_LINE_PCT = 155  # fixed value: line pitch of body paragraphs, in percent


def para_metrics(lines: DataFrame, para: list[str], area: list[str], conventions: Conventions = KOREAN) -> DataFrame:
    """Alignment, role, indent, line pitch and source position of paragraphs.

    `lines` has para keys + (ord, page, col, text, x0, x1, y0, size, left, right) and big, the largest letter of the line. Pieces
    set further right on the row of the line before them belong to the text, but not to indents and pitches. A line alone
    is indented against where most lines of its `area` (the first of the para keys) start, the earlier start on ties. The
    pitch is held against the largest letter of the first line, as the writer will, unless that leaves no room.
    """
    order = Window.partitionBy(*para).orderBy("ord")
    rows = lines.withColumns({f"__p_{c}": F.lag(c).over(order) for c in ("page", "col", "y0", "size", "x1")} | {"__rx": F.col("x0") - F.col("left")})
    beside = ((F.col("__p_page") == F.col("page")) & (F.col("__p_col") == F.col("col")) & (F.abs(F.col("y0") - F.col("__p_y0")) < 0.4 * F.col("__p_size")) & (F.col("x0") > F.col("__p_x1")))
    rows = rows.withColumn("__beside", F.coalesce(beside, F.lit(False)))
    starts = lines.groupBy(*area, F.rint(F.col("x0") - F.col("left")).alias("base")).agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    base = starts.groupBy(*area).agg(F.min_by("base", F.struct(-F.col("n"), F.col("seen"))).alias("base"))
    whole = rows.groupBy(*para).agg(F.count("*").alias("n_whole"), F.median("size").alias("size"))
    heads = rows.where(~F.col("__beside")).withColumns({"__no": F.row_number().over(order), "__same": (F.lag("page").over(order) == F.col("page")) & (F.lag("col").over(order) == F.col("col")), "__dy": F.col("y0") - F.lag("y0").over(order)})
    tol = F.greatest(1.2 * F.first("size").over(order), F.lit(6.0))
    heads = heads.withColumn("__at_right", F.col("x1") >= F.first("right").over(order) - tol)

    def nth(column: str, n: int) -> Column:
        return F.max(F.when(F.col("__no") == n, F.col(column)))

    g = heads.groupBy(*para).agg(
        F.count("*").alias("n"), F.bool_and("__at_right").alias("at_right"), *[nth(c, 1).alias(f"f_{c}") for c in ("x0", "x1", "size", "left", "right", "text", "__rx", "page", "y0", "big")],
        nth("__rx", 2).alias("rx2"), F.median(F.when(F.col("__same") & (F.col("__dy") > 0), F.col("__dy"))).alias("pitch"),
        F.max_by(F.struct("page", "y0"), "ord").alias("last")).join(whole, para).join(base, area)
    width = F.greatest(F.lit(1.0), F.col("f_right") - F.col("f_left"))
    right = (F.col("n") <= 2) & F.col("at_right") & (F.col("f_x0") > F.col("f_left") + 0.3 * width) & (F.col("n_whole") == F.col("n"))
    margins = F.abs((F.col("f_x0") - F.col("f_left")) - (F.col("f_right") - F.col("f_x1")))
    centre = ~right & (F.col("n_whole") == 1) & (margins < 0.04 * width) & (F.col("f_x0") > F.col("f_left") + 0.15 * width)
    start = F.col("f___rx") - F.col("base")
    indent = F.when(right | centre, 0.0).when(F.col("n") >= 2, tx.half_even(F.col("f___rx") - F.col("rx2"), 1)).otherwise(
        F.when(start > 0.4 * F.col("f_size"), tx.half_even(start, 1)).otherwise(0.0))
    against = F.rint(F.col("pitch") / F.greatest(F.col("size"), F.coalesce("f_big", "size")) * 100)
    pct = F.coalesce(F.when(against < 105, F.rint(F.col("pitch") / F.col("size") * 100)).otherwise(against), F.lit(0.0)).cast("int")
    role = F.when((F.col("n_whole") == 1) & tx.rx(F.col("f_text"), conventions.label), "label").when(right & tx.rx(F.col("f_text"), rf"^{SPACE}*[-–—]"), "credit").otherwise("")
    foot = F.col("last.y0") + F.when(pct > 0, pct).otherwise(DEFAULT_LINE_PCT) / 100 * F.col("size")
    return g.select(*para, F.when(right, "RIGHT").when(centre, "CENTER").otherwise("LEFT").alias("align"), role.alias("role"), indent.alias("indent"), pct.alias("line_pct"),
                    F.col("f_page").alias("src_page"), F.col("f_y0").alias("src_y0"), foot.alias("src_y1"), F.col("last.page").alias("src_last"))


def letter_spacing(segments: DataFrame, para: list[str]) -> DataFrame:
    """Letter spacing in percent by the tightest segment; only narrowing of 2 % or more counts, at most 20 %.

    `segments` has para keys + (text, first_x, last_x, size, uniform, overlap): start of the first and last glyph.
    """
    n = F.length("text")
    em = tx.natural_milli_em(F.col("text")) / 1000.0
    last_em = tx.natural_milli_em(F.substring("text", -1, 1)) / 1000.0
    value = (F.col("last_x") - F.col("first_x") + last_em * F.col("size") - em * F.col("size")) / (n * F.col("size"))
    usable = segments.where((n >= 8) & F.col("uniform") & ~F.col("overlap"))
    low = usable.groupBy(*para).agg(tx.half_even(F.min(value) * 100).cast("int").alias("v"))
    return low.select(*para, F.when(F.col("v") <= -2, F.greatest(F.lit(-20), F.col("v"))).otherwise(0).alias("spacing"))


def segments_in_line(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """Numbers the pieces of a line parted by gaps over 1.2 times the size."""
    order = Window.partitionBy(*line).orderBy("gno")
    gap = F.col("x0") - F.lag("x1").over(order) > 1.2 * F.col("size")
    rows = glyphs.withColumn("__cut", F.coalesce(gap, F.lit(False)).cast("int"))
    return rows.withColumn("segment", F.sum("__cut").over(order)).drop("__cut")


def type_boxes(boxes: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Kind of an auxiliary box, whether it is a diagram, and whether its content stands in two columns.

    `boxes` has first_text, drawings, lines, framed, images, wide, parts, left_items, right_items, items.
    """
    title = F.when(tx.rx(F.col("first_text"), conventions.title), tx.norm_title(F.col("first_text"))).otherwise("")
    kind = F.when(title.contains("조건"), "조건").when(title.contains("보기") | (title == ""), "보기").otherwise("기타")
    shown = (F.col("drawings") >= 4) | (F.col("wide") & (F.col("images") >= 2))
    wide = (F.col("drawings") >= 2 * F.col("lines")) | (F.col("framed") >= F.greatest(F.lit(2.0), 0.3 * F.col("lines")))
    diagram = F.when(shown & F.col("wide"), wide).otherwise(shown)
    halves = (F.col("left_items") > 0) & (F.col("right_items") > 0) & (F.col("left_items") + F.col("right_items") == F.col("items"))
    return boxes.withColumns({"title": title, "kind": kind, "diagram": diagram,
                              "two_columns": ~diagram & F.col("wide") & (F.col("parts") == 0) & halves})


def bracket_rows(brackets: DataFrame, lines: DataFrame, box: list[str]) -> DataFrame:
    """Gives each line of a box its nearest bracket row and its side, and measures the rows.

    `brackets` has box keys + (row, x, y0, y1), `lines` box keys + (lid, x0, y0, y1). A box has a handful of brackets.
    """
    cy = (F.col("l.y0") + F.col("l.y1")) / 2
    apart = F.when((cy >= F.col("b.y0") - 2) & (cy <= F.col("b.y1") + 2), 0.0).otherwise(
        F.least(F.abs(cy - F.col("b.y0")), F.abs(cy - F.col("b.y1"))))
    pairs = lines.alias("l").join(brackets.alias("b"), box).select(
        *box, "l.lid", F.col("l.x0").alias("x0"), F.col("l.y0").alias("ly0"), F.col("l.y1").alias("ly1"),
        F.struct(apart.alias("d"), F.col("b.row").alias("row"), F.col("b.x").alias("x"), F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1")).alias("c"))
    near = pairs.groupBy(*box, "lid").agg(F.min("c").alias("c"), F.first("x0").alias("x0"), F.first("ly0").alias("ly0"), F.first("ly1").alias("ly1"))
    return near.groupBy(*box, F.col("c.row").alias("row")).agg(
        F.count_if(F.col("x0") < F.col("c.x")).alias("left"), F.count_if(F.col("x0") >= F.col("c.x")).alias("right"),
        F.least(F.min("c.y0"), F.min("ly0")).alias("top"), F.greatest(F.max("c.y1"), F.max("ly1")).alias("bottom"))


def split_choices(tokens: DataFrame, line: list[str]) -> DataFrame:
    """Cuts a line with several choices: a circled digit after a wide gap, or the next digit after a clear gap.

    `tokens` has line keys + (ord, c, gap, size): pieces between white space with the gap before them. The tokens of one
    printed line are folded; whether the next digit is expected depends on the last cut.
    """
    mark = F.col("c").isin(*CIRCLED)
    order = Window.partitionBy(*line).orderBy("ord")
    whole = Window.partitionBy(*line)
    rows = tokens.withColumns({"__mark": mark, "__prev": F.lag(mark).over(order), "__no": F.row_number().over(order)})
    plain = F.when(F.col("__prev").isNotNull() & ~F.col("__prev") & ~F.col("__mark"), F.col("gap"))
    rows = rows.withColumn("__plain", F.coalesce(F.max(plain).over(whole), F.lit(0.0)))
    digits = F.array(*[F.lit(c) for c in CIRCLED])
    rows = rows.withColumn("__digit", F.array_position(digits, F.col("c")).cast("int"))
    lists = rows.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(
        "ord", F.col("__digit").alias("digit"), "gap", "size", F.col("__plain").alias("plain"), F.col("__no").alias("no")))).alias("t"))

    def advance(state: Column, t: Column) -> Column:
        wide = t["gap"] >= 1.5 * t["size"]
        follows = (t["digit"] == state["want"]) & (t["gap"] >= 0.6 * t["size"]) & (t["gap"] >= 1.6 * t["plain"])
        cut = (t["no"] > 1) & (t["digit"] > 0) & (wide | follows)
        return F.struct(F.when(cut | ((t["no"] == 1) & (t["digit"] > 0)), t["digit"] + 1).otherwise(state["want"]).alias("want"),
                        F.when(cut, F.concat(state["cuts"], F.array(t["ord"]))).otherwise(state["cuts"]).alias("cuts"))

    begin = F.struct(F.lit(0).alias("want"), F.array().cast("array<int>").alias("cuts"))
    cuts = lists.select(*line, F.explode(F.aggregate("t", begin, advance)["cuts"]).alias("ord")).withColumn("__cut", F.lit(1))
    out = tokens.join(cuts, [*line, "ord"], "left").withColumn("__cut", F.coalesce("__cut", F.lit(0)))
    return out.withColumn("choice", F.sum("__cut").over(order)).drop("__cut")


def assemble_questions(items: DataFrame) -> DataFrame:
    """Gives each item behind a question head its place: stem, blocks, choices or after.

    `items` has question, chunk, ord, kind (line or other), mark (line starts with a choice digit), part (line starts a
    written part), far (far from or in another column than the line before), p_full (line before is full), sub (sub-line),
    writes (the choice text asks for writing), credit. Before "after" begins, the state depends on running counts only,
    and "after" never ends, so the state machine is a running count and a running maximum: no fold over a question.
    """
    key, chunk, order = ["question"], ["chunk"], ["ord"]
    line, mark = F.col("kind") == "line", F.col("mark")
    # each running count reads its rows twice, so what it reads is written once and not worked out anew for every reader
    items = settle(items)
    counted = scan.running(items, key, chunk, order, sums={
        "__marks": (line & mark).cast("long"), "__nonwriting": (line & mark & ~F.col("writes")).cast("long"),
        "__opened": (~line | (line & ~mark & F.col("part"))).cast("long")})
    before = F.col("__marks") - (line & mark).cast("long")
    nonwriting = F.col("__nonwriting") - (line & mark & ~F.col("writes")).cast("long")
    ends = F.when(~line, (before > 0) & ((before >= 5) | (nonwriting == 0))).otherwise(
        ~mark & ~F.col("credit") & (before >= 5) & (F.col("far") | ~F.col("p_full")) & ~F.col("sub"))
    flagged = scan.running(settle(counted.select(*items.columns, "__marks", "__opened", before.alias("__before"), ends.cast("int").alias("__ends"))), key, chunk, order,
                           maxes={"__after": F.col("__ends")})
    after = F.col("__after") == 1
    choices = line & (mark | (F.col("__before") > 0))
    state = F.when(after, "after").when(choices, "choices").when(~line, "blocks").when(F.col("__opened") > 0, "blocks").otherwise("stem")
    return settle(flagged.withColumns({"state": state, "choice": F.when(state == "choices", F.col("__marks"))}).select(
        *items.columns, "state", "choice"))


def behind_last(assembled: DataFrame) -> DataFrame:
    """Adds dropped: items of the last question before the answers that stand on a page behind its fifth choice.

    `assembled` is assemble_questions() of items with page and last. Pages don't fall along a question, so all that is
    dropped comes behind all that stays, and the states of the rest are right.
    """
    chosen = (F.col("kind") == "line") & (F.col("state") == "choices")
    upto = (F.col("choice") < 5) | ((F.col("choice") == 5) & F.col("mark"))
    seen = scan.running(assembled, ["question"], ["chunk"], ["ord"], maxes={
        "__most": F.when(chosen, F.col("choice")), "__page": F.when(chosen & upto & (F.col("mark") | ~F.col("credit")), F.col("page"))})
    complete = F.coalesce(F.col("__most") >= 5, F.lit(False)) & ~F.coalesce(chosen & F.col("mark") & (F.col("choice") == 5), F.lit(False))
    return seen.withColumn("dropped", F.col("last") & complete & (F.col("page") > F.col("__page"))).drop("__most", "__page")


def question_roles(assembled: DataFrame) -> DataFrame:
    """Adds role: header for the line in front of the first choice that can head a grid of choices, credit for the source
    of a choice's quotation, else empty.

    `assembled` is assemble_questions() of items with segments (of the line, parted by wide gaps) and chars.
    """
    line = F.col("kind") == "line"
    rows = scan.neighbours(assembled, ["question"], ["chunk"], ["ord"], lead={
        "__opens": line & F.col("mark") & (F.col("state") == "choices") & (F.col("choice") == 1)})
    header = line & (F.col("state") == "blocks") & (F.col("segments") >= 2) & (F.col("chars") <= 40) & F.coalesce("__opens", F.lit(False))
    credit = line & (F.col("state") == "choices") & ~F.col("mark") & F.col("credit")
    return rows.withColumn("role", F.when(header, "header").when(credit, "credit").otherwise("")).drop("__opens")


def choice_parts(lines: DataFrame) -> DataFrame:
    """Adds part: 0 for the text of a choice, then 1, 2, … for the paragraphs set below it.

    `lines` has question, choice, chunk, ord, full, writes, marker and arrow: the lines of choices in order, without credits.
    The text ends at the first line with a marker or an arrow behind a line that ends early or asks for writing. From
    there on each such line opens a paragraph, and any other line does unless the paragraph was opened by an arrow; so what
    opens it is the last marker or arrow, and no fold is needed.
    """
    key, opens = ["question", "choice"], F.col("marker") | F.col("arrow")
    rows = settle(scan.neighbours(settle(lines), key, ["chunk"], ["ord"], lag={"__full": F.col("full"), "__writes": F.col("writes")}))
    rows = scan.running(rows, key, ["chunk"], ["ord"], maxes={"__cut": (opens & (~F.col("__full") | F.col("__writes"))).cast("int")},
                        lasts={"__arrow": F.when(F.col("arrow"), 1).when(F.col("marker"), 0)})
    starts = (F.col("__cut") == 1) & (opens | (F.coalesce("__arrow", F.lit(0)) == 0))
    return scan.running(settle(rows), key, ["chunk"], ["ord"], sums={"part": F.coalesce(starts.cast("long"), F.lit(0))}).select(*lines.columns, "part")


def question_type(choices: DataFrame, keys: list[str]) -> DataFrame:
    """objective, unless every choice asks for writing."""
    return choices.groupBy(*keys).agg(F.when(F.bool_and("writes"), "subjective").otherwise("objective").alias("qtype"))


def choice_grid(segments: DataFrame, question: list[str]) -> DataFrame:
    """Columns of choices that form a grid: four or more, all with the same number (≥ 2) of pieces at the same places.

    `segments` has question keys + (choice, seg, x0, size): pieces behind the choice digit.
    """
    counts = segments.groupBy(*question, "choice").agg(F.count("*").alias("k")).groupBy(*question).agg(
        F.count("*").alias("rows"), F.min("k").alias("k"), F.max("k").alias("__top"))
    even = counts.where((F.col("rows") >= 4) & (F.col("k") >= 2) & (F.col("k") == F.col("__top"))).drop("__top")
    columns = segments.groupBy(*question, "seg").agg(F.median("x0").alias("col_x"))
    apart = segments.join(columns, [*question, "seg"]).groupBy(*question).agg(
        F.max(F.abs(F.col("x0") - F.col("col_x")) - 1.5 * F.col("size")).alias("worst"))
    return even.join(apart.where("worst <= 0").select(*question), question).join(columns, question)


def grid_header(columns: DataFrame, heads: DataFrame, question: list[str]) -> DataFrame:
    """Header piece of each grid column; void for the whole grid if two pieces want the same column."""
    near = heads.join(columns.select(*question, "seg", "col_x"), question).groupBy(*question, "piece").agg(
        F.min(F.struct(F.abs(F.col("x0") - F.col("col_x")).alias("d"), "seg", "text")).alias("m"))
    placed = near.groupBy(*question, F.col("m.seg").alias("seg")).agg(F.count("*").alias("n"), F.first("m.text").alias("text"))
    clean = placed.groupBy(*question).agg(F.max("n").alias("most")).where("most = 1").select(*question)
    return placed.join(clean, question).select(*question, "seg", "text")


def parse_answers(lines: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Splits the answer section into entries of head and body lines.

    `lines` has doc_id, chunk, ord, text, full. An entry's body starts at its explanation mark, or below a head line that
    ends early. Returns the lines with entry (0 = before the first), number and in_body.
    """
    number = F.regexp_extract("text", conventions.answer_head, 1)
    rows = scan.neighbours(lines, FLOW, ["chunk"], ["ord"], lag={"p_full": F.col("full")})
    rows = rows.withColumn("head", number != "")
    rows = scan.running(rows, FLOW, ["chunk"], ["ord"], sums={"entry": F.col("head").cast("long")},
                        lasts={"number": F.when(F.col("head"), number.cast("int"))})
    starts = ~F.col("head") & (tx.rx(F.col("text"), conventions.explanation) | ~F.col("p_full"))
    body = scan.running(rows, [*FLOW, "entry"], ["chunk"], ["ord"], maxes={"__body": starts.cast("int")})
    return body.where("entry > 0").withColumn("in_body", F.col("__body") == 1).select(*lines.columns, "entry", "number", "in_body")


def answer_headings(paras: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Short explanation paragraphs that are headings."""
    t = tx.strip("text")
    is_heading = F.length(t).between(1, 16) & ~tx.rx(t, r"[.?!다]$") & ~tx.rx(t, conventions.marker)
    return paras.withColumn("role", F.when(is_heading, "heading").otherwise(""))


def link_answers(questions: DataFrame, answers: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Answer text of each question by number; the last answer of a number wins."""
    last = answers.groupBy("doc_id", "number").agg(F.max_by("head", "ord").alias("head"))
    text = tx.strip(F.regexp_replace("head", conventions.answer_head, ""))
    return questions.join(last, ["doc_id", "number"], "left").withColumn("answer", F.coalesce(text, F.lit(""))).drop("head")


def underline_negatives(stems: DataFrame, pattern: str) -> DataFrame:
    """Marks negative words in all stems of a document as soon as one stem underlines one.

    `stems` has doc_id, text, underlined (this stem underlines a negative word). Returns the words to underline.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    uses = stems.groupBy("doc_id").agg(F.bool_or(F.col("underlined") & (F.size(found) > 0)).alias("__uses"))
    return stems.join(uses, "doc_id").withColumn("words", F.when(F.col("__uses"), found).otherwise(F.array().cast("array<string>"))).drop("__uses")


def underline_runs(runs: DataFrame, conventions: Conventions = KOREAN) -> DataFrame:
    """Runs of stems with all negative words underlined, in documents that underline one in any stem; others stay.

    `runs` has doc_id, stem, run, text, underline, look (a string for weight, colour and size). Blanks inside such a word go, and
    one is put in front of a word that was joined to the word before it. A word takes the look of its first letter.
    Neighbouring runs that look the same are one. All windows are over one stem, a short text. Runs dealt by document
    are not shuffled again, nor are their letters: these meet the letters of words in a window, and documents on their id.
    """
    stem = ["doc_id", "stem"]
    order = Window.partitionBy(*stem).orderBy("at")
    chars = runs.select(*stem, "run", "underline", "look", F.posexplode(F.split("text", "")).alias("k", "c")).where("c <> ''").withColumn(
        "at", F.row_number().over(Window.partitionBy(*stem).orderBy("run", "k")))
    texts = runs.groupBy(*stem).agg(ordered_concat(["run"], F.col("text")).alias("text"))
    # each match between two signs that no text holds; what lies between them is inside
    marked = texts.select(*stem, F.posexplode(F.split(F.regexp_replace("text", conventions.negative, "\u0001$1\u0002"), "")).alias("k", "c")).where("c <> ''")
    by = Window.partitionBy(*stem).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened, closed = F.sum((F.col("c") == "\u0001").cast("int")).over(by), F.sum((F.col("c") == "\u0002").cast("int")).over(by)
    plain = marked.withColumns({"word": opened, "inside": opened > closed}).where(~F.col("c").isin("\u0001", "\u0002"))
    inside = plain.withColumn("at", F.row_number().over(Window.partitionBy(*stem).orderBy("k"))).where("inside").select(*stem, "at", "word")
    met = chars.unionByName(inside, allowMissingColumns=True).withColumn("word", F.max("word").over(Window.partitionBy(*stem, "at")))
    rows = met.where("c is not null").withColumn("before", F.lag("c").over(order))
    uses = rows.where("word is not null").groupBy("doc_id").agg(F.bool_or("underline").alias("uses"))
    rows = rows.join(uses, "doc_id", "left").withColumn("word", F.when(F.coalesce("uses", F.lit(False)), F.col("word")))
    first = Window.partitionBy(*stem, "word").orderBy("at")
    solid = F.when(~tx.is_space(F.col("c")), F.col("look"))
    changed = F.col("word").isNotNull()
    whole = Window.partitionBy(*stem, "word").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"opens": changed & (F.row_number().over(first) == 1), "new_look": F.when(changed, F.first(solid, ignorenulls=True).over(whole)).otherwise(F.col("look"))})
    joined = F.col("opens") & (F.col("c") == "않") & F.coalesce(tx.rx(F.col("before"), "[가-힣]"), F.lit(False))
    letter = F.struct(F.lit(1).alias("part"), F.col("c").alias("c"), (F.col("underline") | changed).alias("underline"))
    blank = F.struct(F.lit(0).alias("part"), F.lit(" ").alias("c"), F.lit(False).alias("underline"))
    out = rows.where(~(changed & tx.is_space(F.col("c")))).select(*stem, "at", F.col("new_look").alias("look"), F.explode(F.when(joined, F.array(blank, letter)).otherwise(F.array(letter))).alias("l"))
    out = out.select(*stem, "at", "look", "l.*")
    along = Window.partitionBy(*stem).orderBy("at", "part")
    fresh = (F.lag("look").over(along) != F.col("look")) | (F.lag("underline").over(along) != F.col("underline"))
    out = out.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.groupBy(*stem, "run").agg(ordered_concat(["at", "part"], F.col("c")).alias("text"), F.first("underline").alias("underline"), F.first("look").alias("look"))


def paired_boxes(flow: DataFrame) -> DataFrame:
    """Two wide boxes that meet in the middle of a page, as one table of two cells.

    `flow` has doc_id, ord, chunk, kind, parts (the box goes on elsewhere), wide (over both columns, or on a page of one) and
    bounds. A box pairs with the item right behind it if that is such a box too, starts where it ends, to three points,
    and shares 60 % of the lower one's height. A box is in one pair only: along a chain of boxes that could all pair with
    their neighbours it is the first with the second, the third with the fourth. Returns the table with the bounds of both
    cells: ord of the left box, right_ord, x0, middle (its x1), right_x0, x1, y0, y1.
    """
    fields = ("ord", "kind", "parts", "wide", "x0", "y0", "x1", "y1")
    rows = scan.neighbours(flow, FLOW, ["chunk"], ["ord"], lead={f"n_{c}": F.col(c) for c in fields})
    shared = F.least("y1", "n_y1") - F.greatest("y0", "n_y0")
    box = (F.col("kind") == "box") & (F.col("n_kind") == "box") & ~F.col("parts") & ~F.col("n_parts") & F.col("wide")
    meets = box & (F.abs(F.col("x1") - F.col("n_x0")) < 3) & (shared > 0.6 * F.least(F.col("y1") - F.col("y0"), F.col("n_y1") - F.col("n_y0")))
    rows = rows.withColumn("__meets", F.coalesce(meets, F.lit(False)))
    rows = scan.neighbours(rows, FLOW, ["chunk"], ["ord"], lag={"__before": F.col("__meets")})
    chained = scan.islands(rows, FLOW, ["chunk"], ["ord"], F.col("__meets") & ~F.coalesce("__before", F.lit(False)), "__chain")
    placed = scan.numbered(chained.where("__meets"), [*FLOW, "__chain"], ["chunk"], ["ord"], "__no")
    return placed.where(F.col("__no") % 2 == 1).select(
        "doc_id", "ord", F.col("n_ord").alias("right_ord"), "x0", F.col("x1").alias("middle"), F.col("n_x0").alias("right_x0"), F.col("n_x1").alias("x1"),
        F.least("y0", "n_y0").alias("y0"), F.greatest("y1", "n_y1").alias("y1"))


def side_by_side(a: Column, b: Column) -> Column:
    over_y = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    over_x = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    return (over_y > 0.5 * F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])) & (over_x < 0.25 * F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]))


def image_rows(images: DataFrame, area: list[str]) -> DataFrame:
    """Numbers rows of consecutive images standing side by side with every image already in the row.

    An image must at least stand beside the one before it, which cuts the images of a page into short runs; the test
    against all members is folded inside a run. `images` has area keys (one page column) + (ord, x0, y0, x1, y1).
    """
    order = Window.partitionBy(*area).orderBy("ord")
    me = F.struct("ord", "x0", "y0", "x1", "y1")
    rows = images.withColumn("me", me).withColumn("__prev", F.lag("me").over(order))
    apart = F.coalesce(~side_by_side(F.col("__prev"), F.col("me")), F.lit(True)).cast("int")
    rows = rows.withColumn("__cut", apart)
    rows = rows.withColumn("__run", F.sum("__cut").over(order))
    lists = rows.groupBy(*area, "__run").agg(F.array_sort(F.collect_list("me")).alias("run"))

    def advance(state: Column, image: Column) -> Column:
        fits = F.forall(state["row"], lambda r: side_by_side(r, image))
        return F.struct(F.when(fits, F.concat(state["row"], F.array(image))).otherwise(F.array(image)).alias("row"),
                        F.when(fits & (F.size(state["row"]) > 0), state["starts"]).otherwise(F.concat(state["starts"], F.array(image["ord"]))).alias("starts"))

    ord_kind = images.schema["ord"].dataType.simpleString()
    kind = f"array<struct<ord:{ord_kind},x0:double,y0:double,x1:double,y1:double>>"
    begin = F.struct(F.array().cast(kind).alias("row"), F.array().cast(f"array<{ord_kind}>").alias("starts"))
    starts = lists.select(*area, F.explode(F.aggregate("run", begin, advance)["starts"]).alias("ord")).withColumn("__s", F.lit(1))
    out = images.join(starts, [*area, "ord"], "left").withColumn("__s", F.coalesce("__s", F.lit(0)))
    return out.withColumn("row", F.sum("__s").over(order)).drop("__s")


def table_rows(tables: DataFrame, area: list[str]) -> DataFrame:
    """Numbers rows of consecutive tables of equal height range standing to the right of the one before."""
    order = Window.partitionBy(*area).orderBy("ord")
    joins = (F.col("y0") < F.lag("y1").over(order) - 2) & (F.col("y1") > F.lag("y0").over(order) + 2) & (F.col("x0") >= F.lag("x1").over(order) - 2)
    rows = tables.withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    return rows.withColumn("row", F.sum("__new").over(order)).drop("__new")


def cell_align(lines: DataFrame, cell: list[str]) -> DataFrame:
    """CENTER for cells whose lines all have about equal margins."""
    margins = F.abs((F.col("x0") - F.col("cell_x0")) - (F.col("cell_x1") - F.col("x1")))
    even = margins <= F.greatest(F.lit(4.0), 0.12 * (F.col("cell_x1") - F.col("cell_x0")))
    return lines.groupBy(*cell).agg(F.when(F.bool_and(even), "CENTER").otherwise("LEFT").alias("align"))


def rel_size(runs: DataFrame) -> DataFrame:
    rel = F.when((F.col("size") > 0) & (F.col("body") > 0), tx.half_even(F.col("size") / F.col("body"), 2)).otherwise(1.0)
    return runs.withColumn("rel", rel)


def source_gaps(paras: DataFrame) -> DataFrame:
    """Gap above a paragraph in body sizes, and column breaks, from source positions.

    `paras` has doc_id, ord, first_page, y0, expected, last_page, wide, body; rows without a source have null pages.
    """
    rows = scan.neighbours(paras, FLOW, ["chunk"], ["ord"], lag={"p_page": F.col("last_page"), "p_expected": F.col("expected")})
    same = F.col("p_page") == F.col("first_page")
    raw = tx.half_even((F.col("y0") - F.col("p_expected")) / F.col("body"), 2)
    below = same & (F.col("y0") > F.col("p_expected"))
    gap = F.when(below, F.when(F.col("wide"), raw).otherwise(F.least(raw, F.lit(3.0)))).otherwise(0.0)
    breaks = same & ~F.coalesce(below, F.lit(False)) & (F.col("y0") < F.col("p_expected") - 3 * F.col("body")) & ~F.col("wide")
    return rows.withColumns({"gap": F.coalesce(gap, F.lit(0.0)), "col_break": F.coalesce(breaks, F.lit(False))}).drop("p_page", "p_expected")


def doc_stats(items: DataFrame) -> DataFrame:
    """Counts by kind, and the warning that questions and answers differ in number."""
    kinds = ("question", "answer", "guide")
    out = items.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    return out.withColumn("counts_differ", (F.col("answers") > 0) & (F.col("answers") != F.col("questions")))


def document_stats(questions: DataFrame, passages: DataFrame, aux: DataFrame, loose: DataFrame, dropped: DataFrame, answers: DataFrame, heads: DataFrame) -> DataFrame:
    """All counts of a document: questions by type, passages, boxes of questions, loose and dropped items, answers.

    Each table has doc_id and one row for each thing counted; `questions` has qtype, `heads` the question heads found.
    expected_found holds if there are as many heads as answers. One aggregation over the tagged rows, combined before the
    shuffle; a document that no table names is not listed.
    """
    tables = {"passages": passages, "aux_blocks": aux, "loose_items": loose, "dropped_items": dropped, "answers": answers, "heads": heads}
    rows = questions.select("doc_id", F.lit("questions").alias("what"), "qtype")
    for what, table in tables.items():
        rows = rows.unionByName(table.select("doc_id", F.lit(what).alias("what"), F.lit(None).cast("string").alias("qtype")))
    counts = rows.groupBy("doc_id").agg(
        F.count_if(F.col("what") == "questions").alias("questions"), *[F.count_if(F.col("qtype") == t).alias(t) for t in ("objective", "subjective")],
        *[F.count_if(F.col("what") == what).alias(what) for what in tables])
    return counts.withColumns({"expected_found": (F.col("heads") > 0) & (F.col("heads") == F.col("answers")), "counts_differ": (F.col("answers") > 0) & (F.col("answers") != F.col("questions"))}).drop("heads")


def choice_warnings(choices: DataFrame, question: list[str]) -> DataFrame:
    """Questions whose choice labels are not ①②③… in order, or that have neither four nor five choices.

    Compares each label with its place instead of concatenating the labels.
    """
    digits = F.array(*[F.lit(c) for c in CIRCLED])
    off = ~F.col("label").eqNullSafe(F.try_element_at(digits, F.col("choice_ord")))
    out = choices.groupBy(*question).agg(F.bool_or(off).alias("bad_order"), F.count("*").alias("choices"), F.bool_and("writes").alias("writes"))
    return out.select(*question, "bad_order", ((~F.col("choices").isin(4, 5)) & ~F.col("writes")).alias("bad_count"))


def all_runs(paras: DataFrame) -> DataFrame:
    """Every run of every paragraph at any depth: paragraphs are adjacency rows, so this is one explode."""
    rows = paras.select("doc_id", "para_id", "ord", "depth", F.posexplode("runs").alias("run_no", "run"))
    return rows.select("doc_id", "para_id", "ord", "depth", "run_no", F.col("run.text").alias("text"), F.col("run.underline").alias("underline"))


def all_images(paras: DataFrame) -> DataFrame:
    return paras.where("kind = 'image'").select("doc_id", "para_id", "ord", "depth", "ref")


def row_starts(lines: DataFrame) -> DataFrame:
    """Lines that do not continue the row of the line before them to the right."""
    rows = scan.neighbours(lines, FLOW, ["page"], ["ord"], lag={f"p_{c}": F.col(c) for c in ("page", "col", "y0", "size", "x1")})
    same = ((F.col("p_page") == F.col("page")) & (F.col("p_col") == F.col("col"))
            & (F.abs(F.col("y0") - F.col("p_y0")) < 0.4 * F.col("p_size")) & (F.col("x0") > F.col("p_x1")))
    return rows.where(~F.coalesce(same, F.lit(False))).select(*lines.columns)


def line_bounds(lines: DataFrame, boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """Left and right bound that apply to a line: its cell's, else its box's, else its column's; and its offset."""
    b = boxes.select("doc_id", "box", F.col("x0").alias("__b0"), F.col("x1").alias("__b1"))
    c = columns.select("doc_id", "page", "col", F.col("left").alias("__c0"), F.col("right").alias("__c1"))
    out = lines.join(b, ["doc_id", "box"], "left").join(c, ["doc_id", "page", "col"], "left")
    return out.withColumns({
        "left": F.coalesce("cell_left", "__b0", "__c0"), "right": F.coalesce("cell_right", "__b1", "__c1"),
    }).withColumn("rx", F.col("x0") - F.col("left")).drop("__b0", "__b1", "__c0", "__c1")


def cut_lines(lines: DataFrame) -> DataFrame:
    """Cuts lines at a glyph position: two rows with trimmed ends and their own bounds.

    `lines` has glyphs ARRAY<STRUCT<c, x0, x1>> and cut (number of glyphs in the first part; null leaves it whole).
    """
    whole = F.array(F.col("glyphs"))
    both = F.array(F.slice("glyphs", F.lit(1), F.col("cut")), F.slice("glyphs", F.col("cut") + 1, F.size("glyphs")))
    parts = F.when(F.col("cut").isNull(), whole).otherwise(both)
    # what is drawn is picked out once, before the parts become rows; its fields are then read without a function per glyph
    parts = F.transform(parts, lambda p: F.struct(p.alias("glyphs"), F.filter(p, lambda g: g["c"] != " ").alias("solid")))
    rest = [c for c in lines.columns if c != "glyphs"]
    rows = lines.select(*rest, F.posexplode(parts).alias("part", "__p"))
    return rows.where(F.size("__p.solid") > 0).select(
        *rest, "part", F.col("__p.glyphs").alias("glyphs"), tx.strip(F.array_join("__p.glyphs.c", "")).alias("text"),
        F.array_min("__p.solid.x0").alias("x0"), F.array_max("__p.solid.x1").alias("x1"))
