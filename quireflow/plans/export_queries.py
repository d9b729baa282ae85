"""Exports, previews, profiles, and the finished-log twins of the streaming operators."""

import uuid

from pyspark.sql import functions as F

from quireflow.conventions import Conventions
from quireflow.functions import text as tx
from quireflow.operators import export as ops
from quireflow.operators import profile, structure
from quireflow.plans.registry import query, sql_view
from quireflow.plans.structure_queries import digit, text_lines
from quireflow.sources import corpus
from quireflow.sources.corpus import table
from quireflow.session import ensure_checkpoint_dir
from quireflow.sources.tables import order_sources
from quireflow.streaming import bundles, feeds, incremental, jobs

LATIN = Conventions(script=r"\p{L}")


@query("source_order", "A1", """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS input, url AS path, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY url, page_id) AS ord FROM pages""")
def _(spark, folder):
    files = table(spark, folder, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("input"), F.col("url").alias("path"), "page_id")
    return order_sources(files, ["input"], ["page_id"]).select("input", "path", "ord")


@query("table_keys_checked", "A2", """
WITH t AS (SELECT 'glyphs' AS table_name, doc_id IS NULL OR page IS NULL OR frag IS NULL OR gno IS NULL AS n, concat_ws('|', doc_id, page, frag, gno) AS k FROM glyphs
 UNION ALL SELECT 'pages', doc_id IS NULL OR page IS NULL, concat_ws('|', doc_id, page) FROM (SELECT doc_id, page // 2 AS page FROM (SELECT DISTINCT doc_id, page FROM layout_rows))
 UNION ALL SELECT 'images', part % 50 = 0, concat_ws('|', doc_id, page, CASE WHEN part % 50 <> 0 THEN CAST(qty AS INTEGER) END) FROM shapes)
SELECT table_name, count(*) FILTER (n) AS null_keys, (SELECT count(*) FROM (SELECT k FROM t u WHERE u.table_name = t.table_name GROUP BY k HAVING count(*) > 1)) AS repeated_keys FROM t GROUP BY table_name""", ("glyphs", "shapes"))
def _(spark, folder):
    from quireflow.sources.tables import key_violations
    glyphs = corpus.glyphs(spark, folder).select("doc_id", "page", "frag", "gno")
    # two pages under one number, and pictures numbered by their width: keys that fail
    pages = corpus.layout_rows(spark, folder).select("doc_id", "page").distinct().select("doc_id", F.floor(F.col("page") / 2).cast("int").alias("page"))
    images = corpus.shapes(spark, folder).select("doc_id", "page", F.when(F.col("part") % 50 != 0, F.col("qty").cast("int")).alias("img"))
    return key_violations({"glyphs": glyphs, "pages": pages, "images": images})


def turn_items(spark, folder):
    t = structure.segment(corpus.turns(spark, folder))
    is_q = F.col("kind") == "question"
    return t.select("doc_id", "ord", F.when(F.col("kind") == "guide", "passage").otherwise(F.col("kind")).alias("type"), F.when(is_q, F.col("number")).alias("number"),
                    F.when(is_q, "subjective").alias("qtype"), F.when(is_q & (F.col("passage_id") > 0), F.col("passage_id")).alias("passage"), F.when(F.col("kind") == "guide", F.col("text")).alias("guide"),
                    F.when(is_q, F.col("text")).alias("stem"), F.when(F.col("kind") == "answer", F.col("text")).alias("answer"), F.array().cast("array<string>").alias("choices"))


@query("documents_exported", "A3", """
SELECT doc_id, count(*) AS items, count(*) FILTER (kind = 'question') AS numbered, count(*) FILTER (kind = 'guide') AS guided FROM turns GROUP BY doc_id""", ("turns",))
def _(spark, folder):
    items = turn_items(spark, folder)
    warnings = items.where("type = 'question' and number > 3").select("doc_id", F.concat(F.lit("w"), F.col("number").cast("string")).alias("warning"))
    out = ops.export_ir(items, warnings)
    parsed = F.from_json("json", "items array<struct<type:string,number:int,guide:string>>")
    return out.select("doc_id", F.explode(parsed["items"]).alias("i")).groupBy("doc_id").agg(
        F.count("*").alias("items"), F.count("i.number").alias("numbered"), F.count("i.guide").alias("guided"))


@query("lines_exported", "A4", """
SELECT doc_id, page, col, ord, round_even((x0 / 3) * 10, 0) / 10 AS x0, round_even((x1 / 3) * 10, 0) / 10 AS x1, round_even((y0 / 3) * 10, 0) / 10 AS y0, trailing_space, text FROM text_lines""", ("text_lines",))
def _(spark, folder):
    lines = text_lines(spark, folder).withColumns({c: F.col(c) / 3 for c in ("x0", "x1", "y0")}).withColumn("box", F.lit(None).cast("int"))
    return ops.export_lines(lines).drop("box")


def results(spark, folder):
    n = corpus.numbers(spark, folder)
    facts = n.groupBy("doc_id").agg(F.count("*").alias("questions"), F.count_if(F.col("l_returnflag") == "A").alias("objective"), F.count_if(F.col("l_linestatus") == "O").alias("boxes"), F.min("number").alias("low"))
    return facts.select("doc_id", F.when(F.col("low") > 2, "FAIL").when(F.col("low") > 1, "WARN").otherwise("PASS").alias("status"), "questions", "objective", "boxes", (F.col("questions") - 1).alias("expected"),
                        (F.col("objective") / F.col("questions")).alias("coverage"), F.when(F.col("low") > 2, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("causes"),
                        F.array_repeat(F.lit("w"), F.col("questions").cast("int")).alias("warnings"), F.when(F.col("questions") > 9, "boom").alias("error"))


REPORT = """
SELECT doc_id, CASE WHEN q > 9 THEN 'ERROR' WHEN low > 2 THEN 'FAIL' WHEN low > 1 THEN 'WARN' ELSE 'PASS' END AS status, q || ' (' || o || '/' || (q - o) || ')' AS questions, b || '/' || (q - 1) AS boxes, o / q AS coverage,
       CASE WHEN low > 2 THEN 'a; b; c' ELSE '' END AS causes, array_to_string(list_transform(range(least(q, 5)), lambda i: 'w'), '; ') AS warnings
FROM (SELECT doc_id, count(*) AS q, count(*) FILTER (l_returnflag = 'A') AS o, count(*) FILTER (l_linestatus = 'O') AS b, min(number) AS low FROM numbers GROUP BY doc_id)"""


@query("batch_report", "A5", REPORT, ("numbers",))
def _(spark, folder):
    return ops.batch_report(results(spark, folder))


@query("batch_exit_level", "A5", f"SELECT max(CASE status WHEN 'ERROR' THEN 2 WHEN 'FAIL' THEN 1 ELSE 0 END) AS worst FROM ({REPORT})", ("numbers",))
def _(spark, folder):
    return ops.worst(ops.batch_report(results(spark, folder)))


@query("usage_csv", "A6", """
SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, "user", CASE event WHEN 'join' THEN '초대 링크 접속' WHEN 'upload' THEN 'PDF 올리기' WHEN 'convert' THEN '변환' WHEN 'download' THEN '내려받기' ELSE '오류' END AS label,
       '1' AS files, coalesce(CAST(nullif(pages, 0) AS VARCHAR), '') AS pages, coalesce(CAST(nullif(questions, 0) AS VARCHAR), '') AS questions, status, 'k=' || pages AS detail FROM usage ORDER BY usage.ts DESC, id DESC""", ("usage",))
def _(spark, folder):
    return ops.usage_csv(corpus.usage(spark, folder)).drop("seconds")


@query("free_output_names", "A7", """
WITH ex AS (SELECT DISTINCT l_orderkey AS k, CASE l_linenumber WHEN 1 THEN 1 ELSE l_linenumber END AS n FROM lineitem)
SELECT 'f' || k AS stem, CASE WHEN free = 1 THEN 'f' || k ELSE 'f' || k || '_run0' || free END AS name FROM (
 SELECT o_orderkey AS k, (SELECT min(i) FROM range(1, 9) t(i) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.k = o_orderkey AND ex.n = i)) AS free FROM orders)""")
def _(spark, folder):
    stem = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    existing = table(spark, folder, "lineitem").select(F.when(F.col("l_linenumber") == 1, stem("l_orderkey")).otherwise(F.concat(stem("l_orderkey"), F.lit("_run0"), F.col("l_linenumber").cast("string"))).alias("name"))
    return ops.free_names(table(spark, folder, "orders").select(stem("o_orderkey").alias("stem")), existing)


@query("bundle_member_names", "A8", """
SELECT doc_id AS bundle, ord, 'n' || number || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END || '.hwpx' AS name FROM numbers WINDOW w AS (PARTITION BY doc_id, number ORDER BY ord)""", ("numbers",))
def _(spark, folder):
    files = corpus.numbers(spark, folder).select(F.col("doc_id").alias("bundle"), "ord", F.col("number").alias("chunk"), F.concat(F.lit("n"), F.col("number").cast("string")).alias("stem"))
    return ops.unique_names(files).select("bundle", "ord", "name")


@query("bundle_manifest", "A9", """
SELECT doc_id AS bundle, ord, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN lpad(ord::VARCHAR, 2, '0') || '_n' || number ELSE 'n' || number END AS entry FROM numbers""", ("numbers",))
def _(spark, folder):
    files = corpus.numbers(spark, folder).select(F.col("doc_id").alias("bundle"), "ord", F.concat(F.lit("n"), F.col("number").cast("string")).alias("name"))
    return ops.bundle_manifest(files).select("bundle", "ord", "entry")


@query("preview_texts", "A10", """
SELECT doc_id, substr(string_agg(text, chr(13) || chr(10) ORDER BY line_no), 1, 2000) AS preview FROM (
 SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no) - length(text) AS before FROM doc_lines) WHERE before <= 1800 GROUP BY doc_id""", ("doc_lines",))
def _(spark, folder):
    lines = corpus.doc_lines(spark, folder).select("doc_id", F.floor(F.col("line_no") / 512).alias("chunk"), F.col("line_no").alias("item"), F.lit(0).alias("line"), "text")
    return ops.preview_text(lines)


@query("sample_passages", "A11", """
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY ord) FILTER (no <= 7 AND NOT img), '') AS passage, count(*) > count(*) FILTER (no <= 7 AND NOT img) AS more FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, img ORDER BY ord) AS no FROM (
  SELECT doc_id, ord, 'n' || number AS t, l_returnflag = 'R' AS img, l_linestatus, min(l_linestatus) OVER (PARTITION BY doc_id) AS first FROM numbers) WHERE l_linestatus = first) GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    paras = corpus.numbers(spark, folder).select("doc_id", F.col("l_linestatus").alias("passage"), "ord", F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("kind"), F.concat(F.lit("n"), F.col("number").cast("string")).alias("text"))
    return ops.sample(paras)


@query("sample_questions", "A11", """
SELECT q.doc_id, q.text AS stem, coalesce(a.text, '') AS choices FROM turns q LEFT JOIN turns a ON a.doc_id = q.doc_id AND a.kind = 'answer' AND a.number = 1 WHERE q.kind = 'question' AND q.number = 1""", ("turns",))
def _(spark, folder):
    t = corpus.turns(spark, folder)
    return ops.sample_question(t.where("kind = 'question'").select("doc_id", F.col("number").alias("ord"), F.col("text").alias("stem")),
                               t.where("kind = 'answer'").select("doc_id", F.col("number").alias("ord"), F.col("ord").alias("choice_ord"), "text"))


@query("preset_listing", "A13", """
SELECT p_brand AS id, min(p_name) AS name, count(*) AS runs FROM part GROUP BY p_brand""")
def _(spark, folder):
    # brands as presets, through the JSON form the listing reads
    rows = table(spark, folder, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_name").alias("name"), F.count("*").alias("runs"))
    parsed = rows.select("id", F.from_json(F.to_json(F.struct("name", "runs")), "name string, runs bigint").alias("j"))
    return parsed.select("id", F.coalesce("j.name", "id").alias("name"), "j.runs").orderBy("id")


@query("job_results", "A14", """
SELECT o_orderkey AS job, greatest(0, o_orderkey % 1200 - 600) AS seconds_left, o_orderstatus AS status, q AS questions, a AS answers, array_to_string(list_transform(range(least(q, 5)), lambda i: 'w'), '; ') AS warnings
FROM orders JOIN (SELECT l_orderkey, count(*) AS q, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, folder):
    jobs_ = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 1200).alias("download_until"), F.col("o_orderstatus").alias("status"))
    checks = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("questions"), F.count_if(F.col("l_returnflag") == "A").alias("answers"))
    checks = checks.withColumn("warnings", F.array_repeat(F.lit("w"), F.col("questions").cast("int")))
    return ops.result_rows(jobs_, checks, 600)


LAYER = r"""
SELECT doc_id, pages, CAST(round_even(chars / pages, 0) AS BIGINT) AS chars_per_page, CASE WHEN chars / pages < 40 THEN 'scanned' WHEN script < 0.2 * chars OR bad > 0.05 * chars THEN 'garbled' ELSE 'ok' END AS status FROM (
 SELECT doc_id, count(*) AS pages, sum(length(trim(text))) AS chars, sum(length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) AS script, sum(length(text) - length(replace(text, '$', ''))) AS bad FROM doc_lines GROUP BY doc_id)"""


@query("text_layers", "H1", LAYER, ("doc_lines",))
def _(spark, folder):
    pages = corpus.doc_lines(spark, folder).select("doc_id", F.translate("text", "$", "�").alias("text"))
    return profile.text_layer(pages, LATIN)


@query("page_text_layers", "H1", r"""
SELECT page_id AS doc_id, CAST(1 AS BIGINT) AS pages, chars AS chars_per_page, CASE WHEN chars < 40 THEN 'scanned' WHEN script < 0.2 * chars THEN 'garbled' ELSE 'ok' END AS status FROM (
 SELECT page_id, length(trim(t, chr(10) || ' ')) AS chars, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS script FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages))""")
def _(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return profile.text_layer(pages, LATIN)


TITLES = r"""
SELECT doc_id, text, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(size, 0) DESC, length(text) DESC, text) AS rank FROM (
 SELECT doc_id, trim(text) AS text, max(size) AS size FROM layout_rows WHERE page = 1 AND y0 < 140 GROUP BY doc_id, trim(text))
 WHERE length(text) >= 4 AND length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) >= greatest(2, 0.3 * length(replace(text, ' ', '')))) WHERE rank <= 6"""


def titles(spark, folder):
    rows = corpus.layout_rows(spark, folder).where("y0 < 140").select("doc_id", "page", "text", "size")
    return profile.title_candidates(rows, LATIN)


@query("title_candidates", "H2", TITLES, ("layout_rows",))
def _(spark, folder):
    return titles(spark, folder).select("doc_id", "text", "rank")


@query("documents_analyzed", "H3", f"""
SELECT l.*, CASE WHEN status <> 'scanned' THEN coalesce(titles, '') ELSE '' END AS titles, CASE WHEN status <> 'scanned' THEN rows ELSE 0 END AS rows FROM ({LAYER}) l
LEFT JOIN (SELECT doc_id, string_agg(text, ' | ' ORDER BY rank) AS titles FROM ({TITLES}) GROUP BY doc_id) t ON t.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, count(*) AS rows FROM layout_rows GROUP BY doc_id) r ON r.doc_id = l.doc_id""", ("layout_rows",))
def _(spark, folder):
    lines = corpus.doc_lines(spark, folder)
    layer = profile.text_layer(lines.select("doc_id", F.translate("text", "$", "�").alias("text")), LATIN)
    stats = corpus.layout_rows(spark, folder).groupBy("doc_id").agg(F.count("*").alias("rows"))
    first = lines.where("line_no = 0").select("doc_id", F.col("text").alias("passage"))
    out = profile.analyze(layer, titles(spark, folder), stats, first)
    return out.select("doc_id", "pages", "chars_per_page", "status", F.coalesce("titles", F.lit("")).alias("titles"), F.coalesce("rows", F.lit(0)).alias("rows"))


@query("template_titles", "H4", """
SELECT doc_id, title, coalesce(min(line_no) FILTER (line_no <> title AND trim(text) <> ''), -1) AS next FROM doc_lines JOIN (
 SELECT doc_id, arg_max(line_no, (length(trim(text)), line_no)) AS title FROM doc_lines WHERE trim(text) <> '' GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, title""", ("doc_lines",))
def _(spark, folder):
    out = profile.pick_title(corpus.doc_lines(spark, folder).select("doc_id", F.col("line_no").alias("i"), "text"))
    return out.select("doc_id", "title", F.coalesce("next", F.lit(-1)).alias("next"))


def job_events(spark, folder):
    u = corpus.usage(spark, folder)
    name = F.when(F.col("event") == "error", "delete").otherwise(F.col("event"))
    return u.where("event <> 'join'").select(F.col("user").alias("job"), "id", "ts", name.alias("event"))


@query("job_lifecycle", "I1", """
WITH RECURSIVE e AS (SELECT "user" AS job, id, epoch_us(ts) / 1000000.0 AS now, CASE event WHEN 'error' THEN 'delete' ELSE event END AS ev, row_number() OVER (PARTITION BY "user" ORDER BY ts, id) AS k FROM usage WHERE event <> 'join'),
w AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS expires, CAST(NULL AS DOUBLE) AS until, '' AS outcome, CAST(0 AS BIGINT) AS id FROM e
 UNION ALL
 SELECT job, k, CASE WHEN ev = 'upload' THEN now + 1800 WHEN NOT alive OR ev = 'delete' THEN NULL ELSE expires END,
        CASE WHEN ev = 'upload' THEN 0 WHEN NOT alive OR ev = 'delete' THEN NULL WHEN ev = 'convert' THEN least(now + 600, expires) ELSE until END,
        CASE WHEN ev = 'upload' THEN 'opened' WHEN NOT alive THEN 'missing' WHEN ev = 'convert' THEN 'converted' WHEN ev = 'delete' THEN 'deleted' WHEN now <= until THEN 'downloaded' ELSE 'gone' END, id
 FROM (SELECT e.*, w.expires, w.until, w.expires IS NOT NULL AND e.now <= w.expires AS alive FROM w JOIN e ON e.job = w.job AND e.k = w.k + 1))
SELECT job, id, outcome FROM w WHERE k > 0""", ("usage",))
def _(spark, folder):
    return jobs.lifecycle_batch(job_events(spark, folder)).select("job", "id", "outcome")


@query("jobs_expired", "I1", """
WITH e AS (SELECT "user" AS job, id, ts, event FROM usage WHERE event IN ('upload', 'error')),
n AS (SELECT *, lead(ts) OVER (PARTITION BY job ORDER BY ts, id) AS nxt FROM e)
SELECT job, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS ts FROM n WHERE event = 'upload' AND (nxt IS NULL OR nxt > ts + INTERVAL 30 MINUTE)""", ("usage",))
def _(spark, folder):
    return jobs.expired_batch(job_events(spark, folder)).select("job", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("usage_daily_summary", "I2", """
SELECT strftime(ts, '%Y-%m-%d') AS date, "user", count(*) FILTER (event IN ('convert', 'merge')) AS conversions, CAST(coalesce(sum(files) FILTER (event IN ('convert', 'merge')), 0) AS BIGINT) AS files,
       CAST(coalesce(sum(pages) FILTER (event IN ('convert', 'merge')), 0) AS BIGINT) AS pages, CAST(coalesce(sum(questions) FILTER (event IN ('convert', 'merge')), 0) AS BIGINT) AS questions,
       count(*) FILTER (event = 'error' OR status = 'FAIL') AS errors, count(*) FILTER (event = 'download') AS downloads FROM usage GROUP BY 1, 2""", ("usage",))
def _(spark, folder):
    return feeds.daily_usage(corpus.usage(spark, folder))


@query("bundles_ready", "I4", """
SELECT doc_id AS bundle, bool_and(l_returnflag <> 'R' AND until >= 20) AS ready, min(until) AS until, count(*) AS members FROM (SELECT *, CAST(l_quantity AS BIGINT) AS until FROM numbers) GROUP BY doc_id""", ("numbers",))
def _(spark, folder):
    members = corpus.numbers(spark, folder).select(F.col("doc_id").alias("bundle"), (F.col("l_returnflag") != "R").alias("converted"), F.col("l_quantity").cast("long").alias("until"))
    return jobs.bundle_ready(members, 20)


def bundle_events(spark, folder):
    """Four neighbouring users are a bundle's jobs: views join it, errors take a conversion back, large clicks close it."""
    u = corpus.usage(spark, folder)
    event = F.when(F.col("event").isin("join", "upload"), "member").when(F.col("event") == "error", "delete").when(
        (F.col("event") == "download") & (F.col("seconds") > 180), "close").when(F.col("event").isin("convert", "download"), "convert")
    until = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("seconds") * 3600000000).cast("long"))
    return u.select(F.floor(F.col("user").cast("long") / 4).cast("string").alias("bundle"), F.col("user").alias("job"), "id", "ts", event.alias("event"), until.alias("until"))


@query("bundle_flips", "I4", """
WITH e AS (SELECT CAST(CAST("user" AS BIGINT) // 4 AS VARCHAR) AS bundle, "user" AS job, id, epoch_us(ts) AS micros,
             CASE WHEN event IN ('join', 'upload') THEN 'member' WHEN event = 'error' THEN 'delete' WHEN event = 'download' AND seconds > 180 THEN 'close' ELSE 'convert' END AS ev,
             epoch_us(ts) + CAST(floor(seconds * 3600000000) AS BIGINT) AS until FROM usage),
t AS (SELECT *, count(*) FILTER (ev = 'close') OVER (PARTITION BY bundle ORDER BY micros, id) - (ev = 'close')::INT AS turn FROM e),
closed AS (SELECT bundle, turn, micros AS closed FROM t WHERE ev = 'close'),
joined AS (SELECT j.*, c.closed FROM (SELECT bundle, turn, job, min(micros) AS joined FROM t WHERE ev = 'member' GROUP BY ALL) j LEFT JOIN closed c ON c.bundle = j.bundle AND c.turn = j.turn),
held AS (SELECT bundle, job, turn, micros, CASE WHEN ev = 'convert' THEN until END AS until, lead(micros) OVER (PARTITION BY bundle, turn, job ORDER BY micros) AS nxt
         FROM (SELECT bundle, turn, job, micros, arg_max(ev, id) AS ev, arg_max(until, id) AS until FROM t WHERE ev IN ('convert', 'delete') GROUP BY ALL)),
inside AS (SELECT h.bundle, greatest(h.micros, joined) AS a, least(until + 1, coalesce(nxt, until + 1), coalesce(closed, until + 1)) AS b
           FROM held h JOIN joined j ON j.bundle = h.bundle AND j.turn = h.turn AND j.job = h.job WHERE until IS NOT NULL),
steps AS (SELECT bundle, joined AS micros, 1 AS m, 0 AS o FROM joined UNION ALL SELECT bundle, closed, -1, 0 FROM joined WHERE closed IS NOT NULL
          UNION ALL SELECT bundle, a, 0, 1 FROM inside WHERE a < b UNION ALL SELECT bundle, b, 0, -1 FROM inside WHERE a < b),
run AS (SELECT bundle, micros, sum(sum(m)) OVER w AS members, sum(sum(o)) OVER w AS inside FROM steps GROUP BY bundle, micros WINDOW w AS (PARTITION BY bundle ORDER BY micros)),
flips AS (SELECT *, members > 0 AND members = inside AS ready FROM run),
told AS (SELECT *, coalesce(lag(ready) OVER (PARTITION BY bundle ORDER BY micros), false) AS was FROM flips)
SELECT bundle, micros, ready, CAST(members AS BIGINT) AS members FROM told WHERE ready <> was""", ("usage",))
def _(spark, folder):
    return bundles.bundle_flips(bundle_events(spark, folder)).select("bundle", F.unix_micros("ts").alias("micros"), "ready", "members")


@query("documents_updated", "I5", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS batch FROM doc_lines GROUP BY doc_id""", ("doc_lines",))
def _(spark, folder):
    # the first delivery has another first line in every third document; the second has all documents as they are
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stages = [incremental.Stage("lines", "1", lambda texts: texts.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))),
              incremental.Stage("sizes", "1", lambda texts, lines: lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")), ("lines",))]
    store = incremental.DocumentStore(spark, f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}", stages)
    store.update(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("draft\n"), "text")).otherwise(F.col("text"))), 0)
    store.update(docs, 1)
    made_in = store.manifest().where("stage = 'sizes'").select("doc_id", "batch")
    return store.rows("sizes").join(made_in, "doc_id").select("doc_id", "lines", "chars", "batch")
