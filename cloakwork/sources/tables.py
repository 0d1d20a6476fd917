"""Input tables and the sinks of a masking run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_source(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Texts from parquet, JSON lines, CSV, ORC or plain text files; nothing is inferred from CSV or JSON."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    elif fmt in ("json", "csv"):
        raise ValueError("give a schema: inferring one would read the data twice")
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def masked_output(masked: DataFrame, text: str = "text") -> DataFrame:
    """What may leave: no raw text, no values, only counts and the masked text."""
    return masked.withColumn("entities_found", F.size("entities_found").cast("long")).drop(text, "token_map")


def write_masked(masked: DataFrame, path: str, text: str = "text", mode: str = "append") -> None:
    masked_output(masked, text).write.mode(mode).parquet(path)


def write_vault(rows: DataFrame, path: str, day: str | None = None, mode: str = "append") -> None:
    """Token rows go to a place of their own, by day if a timestamp column is named."""
    writer = rows.write.mode(mode)
    if day:
        rows = rows.withColumn("day", F.to_date(day))
        writer = rows.write.mode(mode).partitionBy("day")
    writer.parquet(path)
