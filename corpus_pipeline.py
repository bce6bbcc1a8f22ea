"""A training corpus from documents: language, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their columns; the last
returns token counts and digests. Clean documents pass every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontam, langid, minhash, substrings
from cairn.llm.common import id_bucket, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told; those without letters or between two languages go."""
    learned = langid.fit(docs.filter(id_bucket("doc_id", langid.FOLDS) != langid.HELD_OUT).select("text", "lang"))
    others = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = docs.select("doc_id", "text", *(F.col(c).alias(name) for c, name in others.items()))
    found = langid.predict(own, learned, tuple(others.values()), with_text=True).filter("lang_pred <> 'und' and not ambiguous")
    return found.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id."""
    return minhash.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the strings of 400 bytes that also start elsewhere; n_chars follows the text."""
    return substrings.deduplicated(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokens of all documents that are left; null and empty texts have none."""
    return bpe.token_digests(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again; a table without rows gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
