"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Every stage takes the documents that the one before it kept, reread from Parquet, and gives documents with the same
columns; the last one gives the packed pieces. Null texts and empty tables pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import cascade, mixing, packing, simhash, suffixes
from cloakwork.llm.registry import WORDS_49K
from cloakwork.plans.stored import stored
from cloakwork.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return cascade.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays."""
    return simhash.keep_one(docs, repeated=False)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that begin earlier, too, are cut out of the texts."""
    return suffixes.remove(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to their target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their ids."""
    return packing.pack_documents(docs, WORDS_49K, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]
#: The last stage needs a tokenizer, which SQL has not; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each reads what the one before it wrote."""
    done = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, done if i == 0 else stored(done), sf_dir)
    return done
