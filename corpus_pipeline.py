"""The corpus pipeline: toxicity, quality rules, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and drops what it rejects; all but
the last return the columns of docs, whatever further ones there are and whatever their names. Models are fitted on the
labels of the documents that are still there. No stage fails on nulls in any column, on repeated rows or ids, on very
long texts or on an empty table, which gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, quality_rules, similar, toxicity
from tidemark.llm.common import removed, scratch, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a grade above 0 isn't likelier than not.

    A null or empty text has the severity of no evidence; without labels all stay; repeated rows share their fate.
    """
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list.

    Null and empty texts fail the base rules; without labels these decide alone; repeated rows share their fate.
    """
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of those whose sets of five-word shingles have a similarity of 0.8 or more.

    It is the one of the smallest id (rows without an id come last), of rows that share an id that of the smallest hash of
    its columns; of rows alike in all columns one stays. Texts without a word, null ones too, are one component.
    """
    return similar.first_of_each(docs, width=5, similarity=0.8)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no item of the benchmark away.

    A null or empty text gives nothing away; without an item all stay; repeated rows share their fate.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded_sha256 of every document left.

    A null or empty text has no tokens and the digest of nothing; repeated rows stay repeated.
    """
    both = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(bpe.RANKS))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", not_toxic), ("quality_rules", good_quality), ("simhash", first_copies), ("decontamination", uncontaminated), ("byte_bpe", tokens)]
#: Models and components are beyond SQL; tests/llm/test_pipeline.py checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written as Parquet and read again; the one before is then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
