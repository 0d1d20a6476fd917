"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import cascade, codes, debruijn, lattice, mixing, packing, phrases, rans, sampling, secrets, simhash, suffixes, warc
from cloakwork.llm.sql import ORACLES  # noqa: F401
from cloakwork.llm.tokens import Vocabulary
from cloakwork.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WORDS_49K = Vocabulary(public_tokenizers.path("word_bpe_49k.json"), "words", 1)
BYTES_50K = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), "spaced", 2)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), WORDS_49K)


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.figures(table(spark, folder, "documents"))


@query
def op7_simhash_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op5_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.report(table(spark, folder, "documents"))


@query
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.choose(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return rans.round_trip(table(spark, folder, "documents"), BYTES_50K)


@query
def op9_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return debruijn.report(table(spark, folder, "documents"))


@query
def op3_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.scores(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.report(table(spark, folder, "documents"))


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.report(table(spark, folder, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.report(table(spark, folder, "documents"))


@query
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))
