"""The registered queries of this subpackage and, where SQL can say it, the SQL with the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import (
    best_fit, chaining, hyperdimensional, impact_search, licenses, middle, mixing, packing, simhash, spelling, text_density, toxicity)
from quireflow.llm.common import held_out, table
from quireflow.llm.digest_index import DigestIndex
from quireflow.session import ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(run):
    QUERIES[run.__name__] = run
    return run


# Domains are what the labels say of a document; the weights are shares of all tokens.
MIX_WEIGHTS = {"good": 0.9, "poor": 0.07, "toxic": 0.03}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return table(spark, sf_dir, "labels").select("doc_id", kind.alias("domain"))


@register
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document, with its tokens and its posterior for each domain of the labels."""
    found = mixing.mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), MIX_WEIGHTS)
    return found.select("doc_id", "tokens", "rate", *[F.coalesce(F.col("posteriors")[d], F.lit(0.0)).alias(f"p_{d}") for d in MIX_WEIGHTS])


@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labelled documents that are not held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~held_out("doc_id")))
    scored = toxicity.score(documents, model, {"doc_id": F.col("doc_id"), "held_out": held_out("doc_id")})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the documents that are not held out."""
    documents = table(spark, sf_dir, "documents")
    prototypes = hyperdimensional.fit_prototypes(documents.where(~held_out("doc_id")))
    return hyperdimensional.predict(documents, prototypes, {"doc_id": F.col("doc_id"), "held_out": held_out("doc_id")})


@register
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector with all others."""
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL["op4_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS parts FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.parts, c.parts)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
WHERE rank <= 10
"""


@register
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that two documents share, at least 0.8 alike."""
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


@register
def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose fingerprints of four-word shingles are linked by four or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file is, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return text_density.extract(table(spark, sf_dir, "pages"), {"page_id": F.col("page_id"), "url": F.col("url")})


@register
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through an index of their own, which starts empty."""
    name = f"digest_index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, f"{ensure_checkpoint_dir(spark)}/{name}")
    found = index.absorb(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@register
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, joined by ';' in name order, and its licence sentences, joined by '|' in text order."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ";").alias("licenses"), F.array_join("sentence_ids", "|").alias("sentence_ids"),
                        F.col("n_sentences").cast("bigint").alias("n_sentences"))


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_full_match(s, {quoted(pattern)}) THEN {quoted(name)}" for name, pattern in licenses.SENTENCES)
    plain = "trim(regexp_replace(translate(lower(x), chr(8220)||chr(8221)||chr(8216)||chr(8217)||chr(9)||chr(10)||chr(13)||chr(12), '\"\"''''    '), ' +', ' ', 'g'))"
    ids = lambda part: (
        f"list_filter(list_transform(list_transform({part}, lambda x: regexp_replace({plain}, '[ .!?]+$', '')), lambda s: CASE {cases} END), lambda n: n IS NOT NULL)")

    def rules(seq: str) -> str:
        steps = [f"CASE WHEN len({seq}) = 0 THEN '' ELSE '|' || array_to_string({seq}, '|') || '|' END AS {seq}0"]
        hits = []
        for k, (name, parts) in enumerate(licenses.RULES):
            want = quoted("|" + "|".join(parts) + "|")
            steps.append(f"replace({seq}{k}, {want}, '|-|') AS {seq}{k + 1}")
            hits.append(f"CASE WHEN contains({seq}{k}, {want}) THEN {quoted(name)} END")
        return ", ".join(steps) + f", list_filter([{', '.join(hits)}], lambda n: n IS NOT NULL) AS {seq}_found"

    return rf"""
WITH clean AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^[ \t]*(//+|#+|/\*+|\*+/?|;+|--|<!--)[ \t]*', '', 'g') AS t FROM documents),
cut AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(t, '([.!?])[ \t\r\f]+', '\1' || chr(10), 'g'), '\n+') AS p1,
    regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(t2, '\n[ \t\r\f]*\n', '.' || chr(10) || chr(10), 'g'),
      '([^\n])\n([^\n])', '\1 \2', 'g'), '([.!?])[ \t\r\f]+', '\1' || chr(10), 'g'), '\n+') AS p2
  FROM (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, '\n[ \t\r\f]*\n[ \t\r\f]*(https?://)', ' \1', 'g'),
      ':[ \t\r\f]*\n', ':' || chr(10) || chr(10), 'g'), ':[ \t\r\f]+([0-9*(])', ':' || chr(10) || chr(10) || '\1', 'g') AS t2 FROM clean)),
known AS (SELECT doc_id, {ids('p1')} AS a, {ids('p2')} AS b FROM cut),
ruled AS (SELECT doc_id, a, b, {rules('a')}, {rules('b')} FROM known)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a_found, b_found))), ';') AS licenses,
       array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, '|') AS sentence_ids, greatest(len(a), len(b)) AS n_sentences
FROM ruled
"""


SQL["op10_license_scan"] = _license_sql()


@register
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words, their more frequent spelling one letter away, and where such spellings lead."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@register
def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens, whole where it fits one."""
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle last, and rebuilt from that; both texts as digests."""
    found = middle.restore(middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL["op13_fill_in_middle"] = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
drawn AS (
  SELECT doc_id, t, lines, len(lines) - (t = '' OR right(t, 1) = chr(10))::INT AS n,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4
  FROM hashed),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
heads AS (
  SELECT *, CASE WHEN low = 0 THEN '' WHEN low < len(lines) THEN array_to_string(lines[1:low], chr(10)) || chr(10) ELSE t END AS p,
    CASE WHEN high = 0 THEN '' WHEN high < len(lines) THEN array_to_string(lines[1:high], chr(10)) || chr(10) ELSE t END AS pm
  FROM cuts),
parts AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM heads)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
