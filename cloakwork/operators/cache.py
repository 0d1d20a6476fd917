"""Findings kept across runs: a text that any earlier run has matched is not matched again.

    <root>/rules=<version>/run=<name>/    text hash and its findings, a row for each distinct text

The version is a hash of the rules that are on, so another rule set has a cache of its own. A run brings its texts together by hash and
asks the cache for those hashes only; Spark filters the scan of the cache by a Bloom filter of the run's hashes where that is the smaller
side, and neither side is broadcast by request. Texts that the cache does not have go through the rules and are added under the run's
name. A run that is repeated under its name replaces what it had added, files that an earlier result of that name still reads
included; texts that two runs added at a time count once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.detect import _span_arrays, _span_rows
from cloakwork.plans.skew import join_hot
from cloakwork.plans.stored import stored
from cloakwork.sources.rules import Rule, active_rules

_SPANS = "array<struct<ord:int,start:int,end:int,score:double,value:string>>"
SCHEMA = f"_hash string, _spans {_SPANS}"


def version(rules: list[Rule] | None = None) -> str:
    """Changes with every rule's name, place, expression and case."""
    told = [(r.ord, r.entity_type, r.pattern, r.regex, r.ignore_case) for r in active_rules(rules)]
    return hashlib.sha256(repr(told).encode()).hexdigest()[:16]


def _runs(spark: SparkSession, folder: str, but: str) -> list[str]:
    """Folders of complete runs other than ``but``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    runs = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in runs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(p.toString() for p in done if p.getName() != f"run={but}")


def detect_cached(
    df: DataFrame, root: str, run: str, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> tuple[DataFrame, int]:
    """``detect.candidate_spans`` through the cache below ``root``, and how many distinct texts had to be matched."""
    spark, rules = df.sparkSession, active_rules(rules)
    folder = f"{root}/rules={version(rules)}"
    hashed = df.select(F.col(key), F.col(text).alias("_text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_hash"))
    texts = hashed.groupBy("_hash").agg(F.any_value("_text").alias("_text"))
    known = spark.createDataFrame([], SCHEMA)
    runs = _runs(spark, folder, run)
    if runs:
        kept = spark.read.schema(SCHEMA).parquet(*runs)
        known = kept.join(texts.select("_hash"), "_hash", "left_semi").groupBy("_hash").agg(F.any_value("_spans").alias("_spans"))
    known = stored(known)
    fresh = texts.join(known.select("_hash"), "_hash", "left_anti")
    path = f"{folder}/run={run}"
    _span_arrays(fresh, "_hash", "_text", rules).select("_hash", F.col("_spans").cast(_SPANS).alias("_spans")).write.mode("overwrite").parquet(path)
    added = spark.read.schema(SCHEMA).parquet(path)
    copies = join_hot(hashed.drop("_text"), known.unionByName(added), ["_hash"])
    return _span_rows(copies.select(key, "_spans"), key, rules), added.count()


def forget(spark: SparkSession, root: str, rules: list[Rule] | None = None) -> None:
    """Delete the findings of a rule set."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rules={version(rules)}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
