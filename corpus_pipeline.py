"""From raw documents to packed training sequences, in five stages.

Every stage gets all documents that the one before kept and returns them with the columns
of ``documents``; the last returns packed pieces. :func:`run` writes each stage below the
shared folder and reads it again, so that a lost executor costs one stage at most.

Empty tables pass through every stage. How nulls, empty texts and repeated rows are
treated is said in the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adloom.llm import common as C
from adloom.llm import language, packing, quality, simhash, substrings
from adloom.llm.queries import PIECES, load_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look more like trusted than like raw text."""
    return quality.kept_documents(docs, C.table(spark, sf_dir, "labels", "doc_id", "quality"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known with a posterior of one half or more."""
    return language.kept_documents(docs, language.fit(docs, PIECES))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return simhash.one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return substrings.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack_documents(docs, load_tokenizer)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Language models and fingerprints have no SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.documents(spark, sf_dir)
    for name, stage in STAGES:
        rows = C.staged(stage(spark, rows, sf_dir), name)
    return rows
