"""Whole conversions: from placed glyphs to structured and checked documents."""

from pyspark.sql import functions as F

from quireflow.operators import convert as ops
from quireflow.plans.quality_queries import pieces
from quireflow.plans.registry import query, sql_view
from quireflow.session import settle
from quireflow.sources import corpus


def turn_documents(spark, folder):
    """Glyphs and pages of the conversations as workbooks."""
    rows = corpus.turn_rows(spark, folder)
    return corpus.explode_glyphs(rows), corpus.grid_pages(rows)


sql_view("turn_lines", r"""
SELECT t.*, trim(t.text) AS line FROM (SELECT *, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '#', 'g') AS key, y1 <= 0.12 * 842 OR y0 >= 0.88 * 842 AS outer_band,
        CAST(round_even(y0 / 3, 0) AS INTEGER) AS row FROM turn_rows) t
LEFT JOIN (SELECT c.doc_id, key, row FROM (
             SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '#', 'g') AS key, CAST(round_even(y0 / 3, 0) AS INTEGER) AS row, count(*) AS n
             FROM turn_rows WHERE y1 <= 0.12 * 842 OR y0 >= 0.88 * 842 GROUP BY ALL) c
           JOIN (SELECT doc_id, greatest(2, floor(count(DISTINCT page) * 0.4)) AS need FROM turn_rows GROUP BY doc_id) p ON p.doc_id = c.doc_id
           WHERE n >= need AND length(regexp_replace(key, '[^\p{L}\p{N}_]', '', 'g')) >= 3 AND key NOT LIKE '※%') r
ON r.doc_id = t.doc_id AND r.key = t.key AND r.row = t.row
WHERE NOT (outer_band AND (r.key IS NOT NULL OR regexp_full_match(trim(t.text), '-\s*\d+\s*-')))""", ("turn_rows",))
sql_view("turn_parts", r"""
SELECT doc_id, row_no, page, line, answer, kind, number, ord,
       CASE WHEN answer THEN sum((head AND answer)::INT) OVER (PARTITION BY doc_id ORDER BY row_no) ELSE sum((head AND NOT answer)::INT) OVER (PARTITION BY doc_id ORDER BY row_no) END AS part,
       CASE WHEN NOT answer THEN sum((head AND kind = 'guide')::INT) OVER (PARTITION BY doc_id ORDER BY row_no) END AS passage_id, head
FROM (SELECT *, kind = 'answer' AS answer, wrap = 0 AS head FROM turn_lines)""", ("turn_lines",))


@query("documents_structured", "A2 C15 C10 D2 D3 D4 D7 D22", """
SELECT doc_id, row_no AS frag, line AS text, CASE WHEN answer THEN 'answers' ELSE 'flow' END AS section, CASE WHEN head THEN kind ELSE 'line' END AS kind,
       CASE WHEN answer THEN max(CASE WHEN head AND answer THEN number END) OVER (PARTITION BY doc_id, answer, part) WHEN head AND kind = 'question' THEN number ELSE 0 END AS number,
       CAST(part AS BIGINT) AS part, CAST(coalesce(passage_id, -1) AS BIGINT) AS passage_id FROM turn_parts""", ("turn_parts",))
def _(spark, folder):
    out = ops.structure_of(settle(ops.lines_of(*turn_documents(spark, folder))))
    return out.select("doc_id", "frag", "text", "section", "kind", F.coalesce("number", F.lit(0)).alias("number"), "part", F.coalesce("passage_id", F.lit(-1)).alias("passage_id"))


def written(units):
    """What a faulty writer leaves: every fifth document lacks its second answer, every seventh its second block."""
    lost = ((F.col("doc_id") % 5 == 0) & (F.col("section") == "answers") & (F.col("part") == 2)) | ((F.col("doc_id") % 7 == 0) & (F.col("section") == "flow") & (F.col("part") == 2))
    return units.where(~lost)


@query("documents_checked", "A2 F-1 F-2 F-3 F-4 F-6 F-15", f"""
WITH source AS (SELECT doc_id, row_no, regexp_replace(line, '\\s+', '', 'g') AS c FROM turn_parts),
kept AS (SELECT * FROM turn_parts WHERE NOT (doc_id % 5 = 0 AND answer AND part = 2) AND NOT (doc_id % 7 = 0 AND NOT answer AND part = 2)),
outs AS (SELECT doc_id, regexp_replace(string_agg(line, ' ' ORDER BY row_no), '\\s+', '', 'g') AS c FROM kept GROUP BY doc_id, answer, part),
osh AS (SELECT DISTINCT doc_id, unnest({pieces('c')}) AS sh FROM outs),
lsh AS (SELECT DISTINCT doc_id, row_no, unnest({pieces('c')}) AS sh FROM source),
scored AS (SELECT l.doc_id, l.row_no, l.sh, o.sh IS NOT NULL AS hit FROM lsh l LEFT JOIN osh o ON o.doc_id = l.doc_id AND o.sh = l.sh),
cov AS (SELECT doc_id, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT DISTINCT doc_id, sh, hit FROM scored) GROUP BY doc_id),
mis AS (SELECT doc_id, count(*) AS missing FROM (SELECT doc_id, row_no FROM scored GROUP BY ALL HAVING count(*) FILTER (hit) * 2 < count(*)) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) FILTER (head AND kind = 'question') AS questions, count(*) FILTER (head AND kind = 'answer') AS answers FROM turn_parts GROUP BY doc_id),
lost AS (SELECT doc_id, min(number) AS gap FROM (SELECT doc_id, number FROM turn_parts WHERE head AND kind = 'question' EXCEPT SELECT doc_id, number FROM kept WHERE head AND kind = 'question') GROUP BY doc_id),
f AS (SELECT q.doc_id, coalesce(round_even(hits / n * 10000, 0) / 10000, 0) AS coverage, coalesce(missing, 0) AS missing, questions, answers, coalesce(gap - 1, questions) AS found
      FROM q LEFT JOIN cov ON cov.doc_id = q.doc_id LEFT JOIN mis ON mis.doc_id = q.doc_id LEFT JOIN lost ON lost.doc_id = q.doc_id),
g AS (SELECT *, CASE WHEN coverage < 0.97 THEN 2 WHEN coverage < 0.995 OR missing > 0 THEN 1 ELSE 0 END AS s1,
             CASE WHEN questions = 0 AND answers = 0 THEN 1 WHEN questions > 0 AND found = questions THEN 0 ELSE 2 END AS s2, (answers > 0 AND answers <> questions)::INT AS s3 FROM f)
SELECT doc_id, coverage, missing, questions, answers, found, CASE greatest(s1, s2, s3) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status,
       array_to_string(list_filter([CASE WHEN s1 = 2 THEN 'text_coverage' END, CASE WHEN s2 = 2 THEN 'question_order' END], lambda x: x IS NOT NULL), '; ') AS causes FROM g""", ("turn_parts",))
def _(spark, folder):
    lines = settle(ops.lines_of(*turn_documents(spark, folder)))
    structured = settle(ops.structure_of(lines))
    return ops.checks_of(lines, structured, settle(written(ops.units_of(structured))))
