"""Cleanup of glyphs, text and settings over whole tables."""

from pyspark.sql import functions as F

from quireflow.conventions import DIGIT, SPACE
from quireflow.functions import text as tx
from quireflow.operators import cleanup as ops
from quireflow.plans.registry import query, sql_view
from quireflow.sources import corpus
from quireflow.sources.corpus import table

S = SPACE  # both dialects read this class


@query("hidden_glyphs_dropped", "B1", """
SELECT l_orderkey AS doc_id, count(*) AS kept, sum(l_linenumber)::BIGINT AS numbers FROM lineitem
WHERE l_quantity / 5 >= 3 GROUP BY 1""")
def _(spark, folder):
    g = table(spark, folder, "lineitem").withColumn("size", F.col("l_quantity") / 5)
    return ops.drop_hidden(g).groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.count("*").alias("kept"), F.sum("l_linenumber").alias("numbers"))


@query("bold_glyphs", "B2", """
SELECT font, flags, char_flags, count(*) AS n,
       CASE WHEN lower(font) LIKE '%semibold%' OR lower(font) LIKE '%demibold%' THEN (char_flags & 48) = 48
            ELSE lower(font) LIKE '%bold%' OR (flags & 16) <> 0 OR regexp_matches(font, '[a-z](EB|XB|B)$')
                 OR (char_flags & 48) = 48 END AS bold
FROM glyphs GROUP BY ALL""", ("glyphs",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder).withColumn("bold", tx.is_bold(F.col("font"), F.col("flags"), F.col("char_flags")))
    return g.groupBy("font", "flags", "char_flags", "bold").agg(F.count("*").alias("n"))


@query("ink_colours", "B3", """
SELECT ink, count(*) AS n, coalesce(299 * ('0x' || substr(ink, 2, 2))::INT + 587 * ('0x' || substr(ink, 4, 2))::INT
       + 114 * ('0x' || substr(ink, 6, 2))::INT < 110000, false) AS dark
FROM (SELECT CASE WHEN greatest(r, g, b) < 40 THEN NULL WHEN least(r, g, b) > 235 THEN '#FFFFFF'
             ELSE printf('#%02X%02X%02X', r, g, b) END AS ink
      FROM (SELECT rgb // 65536 AS r, (rgb // 256) % 256 AS g, rgb % 256 AS b
            FROM (SELECT CAST((l_partkey * 65793 + l_suppkey * 257) % 16777216 AS INTEGER) AS rgb FROM lineitem)))
GROUP BY ink""")
def _(spark, folder):
    rgb = ((F.col("l_partkey") * 65793 + F.col("l_suppkey") * 257) % 16777216).cast("int")
    inked = table(spark, folder, "lineitem").select(tx.ink(rgb).alias("ink"))
    return inked.groupBy("ink").agg(F.count("*").alias("n")).withColumn("dark", tx.is_dark(F.col("ink")))


@query("symbol_fonts_remapped", "B4", """
SELECT doc_id, page, row_no, string_agg(CASE WHEN up THEN substr('⁰¹²³⁴⁵⁶⁷⁸⁹', c::INT + 1, 1) ELSE c END, '' ORDER BY gno)
       AS text, sum(CASE WHEN up THEN big ELSE size END) AS sizes
FROM (SELECT *, max(size) OVER (PARTITION BY doc_id, page, row_no) AS big,
             lang = 'fr' AND regexp_matches(c, '^[0-9]$')
             AND size < 0.8 * max(size) OVER (PARTITION BY doc_id, page, row_no) AS up
      FROM (SELECT doc_id, page, frag AS row_no, gno, CASE WHEN raw ~ '[0-9]' THEN 6.0::DOUBLE ELSE size END AS size,
                   CASE WHEN font = 'HeadEB' THEN translate(raw, 'üûýþèçéêðïñòlnu§o¡', '✓✗☒☑→←↑↓⇨⇦⇧⇩●■◆▪□○')
                        ELSE raw END AS c, CASE WHEN font = 'SerifSemiBold' THEN 'fr' ELSE 'x' END AS lang
            FROM (SELECT *, c AS raw FROM glyphs)))
GROUP BY doc_id, page, row_no""", ("glyphs",))
def _(spark, folder):
    # German text is set in a symbol font; French capitals and digits sit at the equation font's private code points
    private = "".join(chr(0xE033 + k) for k in range(10)) + "".join(chr(0xE000 + k) for k in range(26))
    plain = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    g = corpus.glyphs(spark, folder)
    digit = tx.rx(F.col("c"), "[0-9]")
    g = g.withColumn("size", F.when(digit, 6.0).otherwise(F.col("size"))).withColumn(
        "c", F.when(F.col("font") == "SerifSemiBold", F.translate("c", plain, private)).otherwise(F.col("c"))).withColumn(
        "font", F.when(F.col("font") == "HeadEB", "Wingdings").when(F.col("font") == "SerifSemiBold", "HancomEQN")
        .otherwise(F.col("font")))
    out = ops.remap_symbols(g)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gno", "c"))), lambda x: x["c"]), "")
    return out.groupBy("doc_id", "page", F.col("frag").alias("row_no")).agg(text.alias("text"), F.sum("size").alias("sizes"))


@query("mismapped_spaces", "B5", """
SELECT c, count(*) AS n, sum(gno)::BIGINT AS gnos
FROM (SELECT gno, CASE WHEN c IN ('$', '%', '#', '&', '@') AND (CASE WHEN gno % 2 = 1 THEN 3 ELSE 5 END) < 0.36 * size
                       THEN ' ' ELSE c END AS c FROM glyphs) GROUP BY c""", ("glyphs",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder)
    g = g.withColumn("x1", F.col("x0") + F.when(F.col("gno") % 2 == 1, 3).otherwise(5))
    return ops.fix_spaces(g).groupBy("c").agg(F.count("*").alias("n"), F.sum("gno").alias("gnos"))


@query("unknown_glyphs", "B6", """
SELECT c, count(*) AS n, sum(gno)::BIGINT AS gnos
FROM (SELECT gno, CASE WHEN c <> '*' THEN c WHEN gno % 10 = 0 THEN ' ' WHEN gno % 10 <= 0.06 * size * size THEN '•'
                       ELSE chr(65533) END AS c FROM glyphs) GROUP BY c""", ("glyphs",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder).withColumn("ink", (F.col("gno") % 10).cast("double")).withColumn(
        "c", F.when(F.col("c") == "*", "�").otherwise(F.col("c")))
    return ops.fix_unknown(g).groupBy("c").agg(F.count("*").alias("n"), F.sum("gno").alias("gnos"))


@query("overprint_dropped", "B7", """
WITH RECURSIVE g AS (
  SELECT doc_id, page, frag, gno, 2.0 * gno AS x0, run, row_number() OVER (PARTITION BY doc_id, page, frag, run ORDER BY gno) AS k
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, frag ORDER BY gno) AS run
        FROM (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id, page, frag ORDER BY gno) THEN 0 ELSE 1 END AS fresh
              FROM glyphs))),
 step AS (
  SELECT doc_id, page, frag, run, k, gno, x0 AS kept, true AS keep FROM g WHERE k = 1
  UNION ALL
  SELECT g.doc_id, g.page, g.frag, g.run, g.k, g.gno, CASE WHEN abs(s.kept - g.x0) < 3 THEN s.kept ELSE g.x0 END,
         NOT abs(s.kept - g.x0) < 3
  FROM step s JOIN (SELECT * FROM g WHERE k > 1) g ON g.doc_id = s.doc_id AND g.page = s.page AND g.frag = s.frag
       AND g.run = s.run AND g.k = s.k + 1)
SELECT doc_id, count(*) AS kept, sum(gno)::BIGINT AS gnos FROM step WHERE keep GROUP BY doc_id""", ("glyphs",))
def _(spark, folder):
    g = corpus.glyphs(spark, folder).select("doc_id", "page", "frag", "gno", "c", (F.col("gno") * 2.0).alias("x0"),
                                            F.lit(10.0).alias("size"))
    return ops.dedupe_overprint(g).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("gno").alias("gnos"))


@query("repeat_keys", "B8", f"""
SELECT key, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(text, '{S}+', '', 'g'), '{DIGIT}+', '#', 'g') AS key
FROM doc_lines) GROUP BY key""", ("doc_lines",))
def _(spark, folder):
    return corpus.doc_lines(spark, folder).groupBy(tx.norm_repeat("text").alias("key")).agg(F.count("*").alias("n"))


@query("compact_texts", "B9", f"""
SELECT doc_id, length(a) AS chars, md5(a) AS plain, md5(regexp_replace(a, '{DIGIT}+', '#', 'g')) AS masked
FROM (SELECT doc_id, regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}\\x{{F8F0}}]+', '', 'g') AS a FROM documents)""")
def _(spark, folder):
    a, b = tx.compact("text"), tx.compact("text", numbers=False)
    return table(spark, folder, "documents").select("doc_id", F.length(a).alias("chars"), F.md5(a).alias("plain"),
                                                    F.md5(b).alias("masked"))


@query("natural_widths", "B10", r"""
SELECT doc_id, line_no, CAST(coalesce(list_sum(list_transform(string_split(text, ''), lambda c:
  CASE WHEN c = '' THEN 0 WHEN c = ' ' THEN 260 WHEN c IN ('.', ',', '‘', '’', '·') THEN 250 WHEN c = '''' THEN 220
       WHEN c IN ('(', ')') THEN 346 WHEN c IN ('[', ']') THEN 360 WHEN c IN (':', ';') THEN 286 WHEN c = '-' THEN 310
       WHEN c = '!' THEN 330 WHEN c = '?' THEN 470 WHEN c IN ('"', '“', '”') THEN 410
       WHEN ascii(c) BETWEEN 4352 AND 4607 OR ascii(c) BETWEEN 11904 AND 40959 OR ascii(c) BETWEEN 44032 AND 55203
            OR ascii(c) BETWEEN 57344 AND 64255 OR ascii(c) BETWEEN 65280 AND 65376 THEN 1000
       WHEN ascii(c) < 128 THEN 560 ELSE 800 END)), 0) AS BIGINT) AS milli_em FROM doc_lines""", ("doc_lines",))
def _(spark, folder):
    return corpus.doc_lines(spark, folder).select("doc_id", "line_no", tx.natural_milli_em("text").alias("milli_em"))


sql_view("word_runs", """
SELECT doc_id, row_no, ord, w || '  ' AS text, length(w) % 3 = 0 AS underline, length(w) % 2 AS look
FROM (SELECT doc_id, row_no, unnest(ws) AS w, unnest(range(len(ws))) AS ord
      FROM (SELECT doc_id, row_no, string_split(text, ' ') AS ws FROM layout_rows))""", ("layout_rows",))


@query("clean_runs", "B11", r"""
WITH merged AS (
 SELECT doc_id, row_no, n, string_agg(t, '' ORDER BY ord) AS text, any_value(underline) AS underline, min(ord) AS ord
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, row_no ORDER BY ord) AS n
       FROM (SELECT *, CASE WHEN lag(underline) OVER w = underline AND lag(look) OVER w = look THEN 0 ELSE 1 END AS fresh
             FROM (SELECT *, CASE WHEN underline AND trim(text) = '' THEN text
                                  ELSE regexp_replace(text, '[ \t]{2,}', ' ', 'g') END AS t FROM word_runs)
             WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY ord)))
 GROUP BY doc_id, row_no, n),
trimmed AS (
 SELECT *, CASE WHEN n = max(n) OVER (PARTITION BY doc_id, row_no) AND NOT (underline AND trim(text) = '')
                THEN rtrim(first) ELSE first END AS final
 FROM (SELECT *, CASE WHEN n = min(n) OVER (PARTITION BY doc_id, row_no) THEN ltrim(text) ELSE text END AS first FROM merged))
SELECT doc_id, row_no, string_agg(final || CASE WHEN underline THEN '_' ELSE '|' END, '' ORDER BY ord) AS runs
FROM trimmed WHERE final <> '' GROUP BY doc_id, row_no""", ("word_runs",))
def _(spark, folder):
    rows = corpus.layout_rows(spark, folder).select("doc_id", "page", "row_no", F.posexplode(F.split("text", " ")).alias("ord", "w"))
    runs = rows.select("doc_id", "page", "row_no", "ord", F.concat("w", F.lit("  ")).alias("text"),
                       (F.length("w") % 3 == 0).alias("underline"), (F.length("w") % 2).alias("look"))
    out = ops.clean_runs(runs, ["doc_id", "page", "row_no"])
    shown = F.concat("text", F.when(F.col("underline"), "_").otherwise("|"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("t")))), lambda r: r["t"]), "")
    return out.groupBy("doc_id", "page", "row_no").agg(joined.alias("runs")).drop("page")


@query("titles_normalised", "B12", f"""
SELECT t, count(*) AS n, regexp_matches(t, '^{S}*[<〈＜《]{S}*[^<>〈〉＜＞]{{1,14}}{S}*[>〉＞》]{S}*$') AS is_title
FROM (SELECT regexp_replace(regexp_replace(trim(regexp_replace(raw, '{S}+', ' ', 'g')), '^[<〈＜《]{S}*', '<'),
                            '{S}*[>〉＞》]$', '>') AS t
      FROM (SELECT CASE WHEN length(text) % 2 = 0 THEN ' 〈  ' ELSE '＜' END || text || ' 》' AS raw FROM doc_lines))
GROUP BY t""", ("doc_lines",))
def _(spark, folder):
    from quireflow.conventions import KOREAN
    raw = F.concat(F.when(F.length("text") % 2 == 0, " 〈  ").otherwise("＜"), F.col("text"), F.lit(" 》"))
    out = corpus.doc_lines(spark, folder).groupBy(tx.norm_title(raw).alias("t")).agg(F.count("*").alias("n"))
    return out.withColumn("is_title", tx.rx(F.col("t"), KOREAN.title))


@query("recognised_text_repaired", "B13", r"""
SELECT doc_id, line_no, text_out AS text FROM (
 SELECT doc_id, line_no, list_reduce(list_transform(string_split_regex(t, '[“"''‘’”`]'), lambda x, i: CASE WHEN i = 1 THEN x
        WHEN i % 2 = 0 THEN '‘' || x ELSE '’' || x END), lambda a, b: a || b) AS text_out
 FROM (SELECT doc_id, line_no, (line_no % 10) || '.윗글의 가장적절한 "' || text || '" <보기> ‘은?' AS t FROM doc_lines))""", ("doc_lines",))
def _(spark, folder):
    raw = F.concat((F.col("line_no") % 10).cast("string"), F.lit("..워글의 기장적절한 \""), F.col("text"),
                   F.lit("\" \"보기> `은？"))
    return corpus.doc_lines(spark, folder).select("doc_id", "line_no", tx.repair_text(raw).alias("text"))


@query("safe_file_names", "B14", r"""
SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''),
       '[^/]*$'), '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 120), ''), 'page.html') AS name FROM pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.safe_name("url", "page.html").alias("name"))


AGENTS = ["Mozilla/5.0 (iPhone; CPU)", "Mozilla/5.0 (Linux; ANDROID 14)", "Mozilla/5.0 (Windows NT 10.0)",
          "Mozilla/5.0 (Macintosh; Intel Mac OS X)", "Mozilla/5.0 (X11; Linux x86_64)", "curl/8"]


@query("device_classes", "B15", """
SELECT device, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'iPhone/iPad' WHEN 1 THEN 'Android' WHEN 2
       THEN 'Windows' WHEN 3 THEN 'Mac' WHEN 4 THEN 'Linux' ELSE '기타' END AS device FROM part) GROUP BY device""")
def _(spark, folder):
    agents = F.array(*[F.lit(a) for a in AGENTS])
    ua = F.element_at(agents, (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, folder, "part").groupBy(tx.device_of(ua).alias("device")).agg(F.count("*").alias("n"))


@query("causes_redacted", "B16", r"""
SELECT doc_id, array_to_string(list_transform(lines[1:4], lambda c: trim(substr(trim(c), 1, 80))), '|') AS causes
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def _(spark, folder):
    causes = F.transform(F.split("text", "\n"), lambda c: F.concat(c, F.lit("  (누락 줄 예: "), c, F.lit(")")))
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.transform(tx.redact_causes(causes), tx.strip), "|").alias("causes"))


@query("detail_whitelisted", "B17", """
SELECT event_type, count(*) AS n, '' AS k, sum(length(event_type))::BIGINT AS font_chars FROM events GROUP BY event_type""")
def _(spark, folder):
    detail = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("font"), F.col("event_type")))
    rows = table(spark, folder, "events").withColumn("d", tx.scrub_detail(detail))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("d")["k"], F.lit(""))).alias("k"),
                                          F.sum(F.length(F.col("d")["font"])).alias("font_chars"))


@query("settings_clamped", "B18", """
SELECT id, least(16, greatest(7, total / 20000)) AS body_size, CAST(least(24, greatest(9, id % 40)) AS DOUBLE) AS title_size,
       12.0::DOUBLE AS academy_size, substr(trim(prio), 1, 30) AS academy_name, '' AS title,
       CASE WHEN id % 3 = 0 THEN '#00FF7A' ELSE '#000000' END AS title_color, '함초롬바탕' AS body_font,
       true AS header_enabled, true AS uses_masterpage
FROM (SELECT o_orderkey AS id, o_totalprice AS total, '  ' || o_orderpriority || ' ' || o_orderpriority || o_orderpriority
      || o_orderpriority AS prio FROM orders)""")
def _(spark, folder):
    p = F.col("o_orderpriority")
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 20000).alias("body_size"),
        (F.col("o_orderkey") % 40).cast("double").alias("title_size"), F.lit(None).cast("double").alias("academy_size"),
        F.concat(F.lit("  "), p, F.lit(" "), p, p, p).alias("academy_name"), F.lit(" ").alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, " #00ff7a ").otherwise("red").alias("title_color"),
        F.lit("").alias("body_font"), F.lit(False).alias("frame"))
    return ops.clamp_settings(df).drop("frame")


@query("access_lists", "B19", """
SELECT nation, key, name FROM (
 SELECT s_nationkey AS nation, replace(s_name, 'Supplier#', '') AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'user' ELSE 'n' || s_suppkey END AS name
 FROM supplier WHERE s_suppkey % 5 <> 2)""")
def _(spark, folder):
    s = table(spark, folder, "supplier")
    key = F.regexp_replace("s_name", "Supplier#", "")
    entry = (F.when(F.col("s_suppkey") % 5 == 2, F.concat(F.lit("x:"), F.substring(key, 1, 7)))
             .when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit(" "), key))
             .otherwise(F.concat(F.lit("n"), F.col("s_suppkey").cast("string"), F.lit(":"), key, F.lit(" "))))
    raw = s.select(F.col("s_nationkey").alias("nation"), F.concat(entry, F.lit(", ,")).alias("raw"))
    return ops.parse_access(raw).select("nation", "key", "name")


@query("uploads_admitted", "B20", """
SELECT doc_id, CASE WHEN n_chars > 8000 THEN 'too_large' WHEN text NOT LIKE 'T%' THEN 'not_pdf'
       WHEN len(string_split(text, chr(10))) > 12 THEN 'too_many_pages' ELSE '' END AS reason FROM documents""")
def _(spark, folder):
    jobs = table(spark, folder, "documents").select(
        "doc_id", F.col("n_chars").alias("size"), F.when(F.col("text").startswith("T"), "%PDF-1.7").otherwise("PK").alias("header"),
        F.size(F.split("text", "\n")).alias("pages"))
    return ops.admit(jobs, 8000, 12).select("doc_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("bundles_admitted", "B20", """
SELECT bundle, files, pages, coalesce(CASE WHEN files > 10 THEN 'too_many_files' WHEN jobs <> files THEN 'duplicate'
       WHEN files < 2 THEN 'too_few' WHEN pages > 200 THEN 'too_many_pages' END, '') AS reason
FROM (SELECT l_orderkey AS bundle, count(*) AS files, sum(l_quantity)::BIGINT AS pages, count(DISTINCT l_linenumber) AS jobs
      FROM lineitem GROUP BY 1)""")
def _(spark, folder):
    members = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("bundle"), F.col("l_linenumber").alias("job"), F.col("l_quantity").cast("int").alias("pages"))
    return ops.admit_bundle(members).withColumn("reason", F.coalesce("reason", F.lit("")))


@query("styles_encoded", "B21", """
SELECT doc_id, ord, CAST(style_id AS INTEGER) AS style_id FROM (
 SELECT n.doc_id, ord, f.style_id FROM numbers n JOIN (
  SELECT doc_id, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) AS style_id
  FROM numbers GROUP BY doc_id, l_returnflag, l_linestatus) f
 ON n.doc_id = f.doc_id AND n.l_returnflag = f.l_returnflag AND n.l_linestatus = f.l_linestatus)""", ("numbers",))
def _(spark, folder):
    out = ops.encode_styles(corpus.numbers(spark, folder), ["doc_id"], ["ord"], ["l_returnflag", "l_linestatus"])
    return out.select("doc_id", "ord", "style_id")


@query("run_sizes", "B22", """
SELECT l_quantity AS rel20, CAST(CASE WHEN abs(l_quantity / 20 - 1.0) >= 0.08
       THEN greatest(500, least(floor(round_even(10.0 * (l_quantity / 20) * 2, 0) / 2 * 100), 3000)) ELSE 0 END AS INTEGER) AS height,
       count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, folder):
    runs = table(spark, folder, "lineitem").select("l_quantity", (F.col("l_quantity") / 20).alias("rel"), F.lit(10.0).alias("size"))
    return ops.run_look(runs).groupBy(F.col("l_quantity").alias("rel20"), "height").agg(F.count("*").alias("n"))


@query("images_fitted", "B23", """
SELECT doc_id, page, sid, CAST(greatest(200, CASE WHEN h1 > 9000 THEN floor(w1 * 9000.0 / h1) ELSE w1 END) AS BIGINT) AS out_w,
       CAST(greatest(200, least(h1, 9000)) AS BIGINT) AS out_h
FROM (SELECT doc_id, page, sid, least(w, 20000) AS w1, CASE WHEN w > 20000 THEN floor(h * 20000.0 / w) ELSE h END AS h1
      FROM (SELECT doc_id, page, sid, floor((x1 - x0) * 110) AS w, floor((y1 - y0) * 110) AS h FROM shapes))""", ("shapes",))
def _(spark, folder):
    images = corpus.shapes(spark, folder).select("doc_id", "page", "sid", (F.col("x1") - F.col("x0")).alias("width"),
                                                 (F.col("y1") - F.col("y0")).alias("height"))
    return ops.fit_images(images, 20000, 9000).select("doc_id", "page", "sid", "out_w", "out_h")


@query("row_widths_shared", "B24", """
SELECT doc_id, ord, CAST(floor((26362 - 500 * (count(*) OVER w - 1)) * l_quantity / sum(l_quantity) OVER w) AS BIGINT) AS share
FROM numbers WINDOW w AS (PARTITION BY doc_id)""", ("numbers",))
def _(spark, folder):
    items = corpus.numbers(spark, folder).select("doc_id", "ord", F.col("l_quantity").alias("width"))
    return ops.share_width(items, ["doc_id"], 26362, 500).select("doc_id", "ord", "share")


@query("header_cell_widths", "B25", """
SELECT id, CAST(greatest(6000, least(20000, floor((length(name) * 12.0 + CASE WHEN sub <> '' THEN
       (length(sub) + 0.5) * 9.0 ELSE 0.0 END)::DOUBLE * 98) + 1600)) AS BIGINT) AS cell_width
FROM (SELECT o_orderkey AS id, o_orderpriority AS name, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS sub FROM orders)""")
def _(spark, folder):
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("academy_name"), F.lit(12.0).alias("academy_size"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("").alias("academy_sub"),
        F.lit(9.0).alias("academy_sub_size"))
    return ops.header_width(df).select("id", "cell_width")


@query("indents_converted", "B26", """
SELECT price, CAST(greatest(-3000, least(3000, CAST(round_even((price / 400 - 100) * 11, 0) AS INTEGER) * 10)) AS INTEGER) AS indent,
       CAST(round_even(1430.0 * (size / 10.0) / 100, 0) * 10 AS INTEGER) AS hang, count(*) AS n
FROM (SELECT l_extendedprice AS price, l_quantity AS size FROM lineitem) GROUP BY 1, 2, 3""")
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.groupBy(
        F.col("l_extendedprice").alias("price"), ops.indent_units(F.col("l_extendedprice") / 400 - 100).alias("indent"),
        ops.hang_units(F.lit(1430.0), F.col("l_quantity") / 10.0).alias("hang")).agg(F.count("*").alias("n"))
