"""A corpus pipeline: language, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns they got, whatever their names, as they were.

Defined results, stage by stage: rows with null text or no letter leave at the first; null doc_ids are documents, they
are never learned from, and sort after others; of repeated rows one stays after exact deduplication; texts without words never
reach the join; an empty table passes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from popspark.llm.common import folded, stored, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told stay; ``lang`` is learned from three quarters of the labelled rows."""
    known = F.coalesce(folded() % 4 != 2, F.lit(False))
    models = language_id.automata(docs.filter(known))
    told, score = unused(docs, "lang_told"), unused(docs, "lang_score")
    rows = language_id.identify(docs, models, told, score, keep_text=True)
    return rows.filter(F.col(told) != language_id.UNKNOWN).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the least doc_id stays."""
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the least doc_id; of null doc_ids one for each component."""
    return ngram_join.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and a digest of the text that the ids decode to."""
    return bpe.encode_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("bpe", encoded)]

#: Neither language identification nor hashed rounding can be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
