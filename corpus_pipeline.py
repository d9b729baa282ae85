"""From raw documents to packed sequences: each stage works on all rows its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import hyperdimensional, mixing, packing, simhash
from quireflow.llm.common import DOCUMENT_COLUMNS, table
from quireflow.llm.digest_index import DigestIndex, keep_first_copies
from quireflow.llm.queries import MIX_WEIGHTS, labelled_domains, tokenizer_path
from quireflow.session import ensure_checkpoint_dir, settle

# A text of LEAST_CHARS characters or more whose cosine with every language is under LEAST_COSINE is in none of them.
# Shorter ones say too little to be rejected, unless they have no letter at all.
LEAST_CHARS, LEAST_COSINE = 100, 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that `lang` names stay; without any such language all with a letter do."""
    prototypes = hyperdimensional.fit_prototypes(docs)
    found = hyperdimensional.predict(docs, prototypes, {c: F.col(c) for c in DOCUMENT_COLUMNS})
    if not prototypes:
        return found.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*DOCUMENT_COLUMNS)
    strange = (F.length("text") >= LEAST_CHARS) & (F.col("score") < LEAST_COSINE)
    return found.where((F.col("lang_pred") != "und") & ~strange).select(*DOCUMENT_COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id stays."""
    name = f"digest_index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, f"{ensure_checkpoint_dir(spark)}/{name}")
    return keep_first_copies(docs, index.absorb(docs)).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by the classes of op6 or five-word shingles alike to 0.8, and chains of both, the one with the smallest doc_id stays."""
    return simhash.keep_one_of_each(docs, class_bits=4).select(*DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, for the shares of tokens that MIX_WEIGHTS gives the domains of the labels."""
    return mixing.resample(docs, labelled_domains(spark, sf_dir), MIX_WEIGHTS).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", pack)]

# Language ID, fingerprints and tokens have no form in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
