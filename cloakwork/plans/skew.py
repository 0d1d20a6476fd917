"""Joins and running values that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def join_hot(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many rows to few rows per key when some keys may be very frequent in ``df``.

    Adaptive execution measures the shuffled partitions and splits those that a frequent key has blown up, so no
    key is counted beforehand. It only does so between two plain shuffles: a ``dim`` that is an aggregate shuffled
    by the same keys should be stored first.
    """
    return df.join(dim, keys, how)


def join_large(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two sides that both grow with the spans; neither is sent to the driver to be broadcast.

    The size that a plan is made by is that of compressed files, and rows that are exploded count once. Spans compress to a few
    bytes each, so by that size millions of them look small, and broadcasting them takes the driver hundreds of megabytes.
    """
    return df.join(other.hint("merge"), keys, how)


_RUNNING = {"sum": F.sum, "max": F.max}


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    value: Column,
    out: str,
    how: str = "sum",
    empty: Column | None = None,
) -> DataFrame:
    """Add ``out``: sum or maximum of ``value`` over the rows before this one, per ``keys``.

    The order must begin with ``bucket`` ascending. Buckets cut a long group into pieces: the window
    runs inside one bucket, and what lies before it comes from one pre-aggregated row per bucket. So no
    task ever sees a whole group, only a bucket or the list of buckets.
    """
    agg = _RUNNING[how]
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = (Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_bucket").agg(agg("_value").alias("_total"))
    heads = totals.select(
        *keys,
        "_bucket",
        agg("_total").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*before)).alias("_head"),
    )
    inner = df.withColumn(
        "_inner", agg("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(*before))
    )
    joined = join_large(inner, heads, [*keys, "_bucket"])
    if how == "sum":
        result = F.coalesce(F.col("_inner"), F.lit(0)) + F.coalesce(F.col("_head"), F.lit(0))
    else:
        result = F.greatest(F.col("_inner"), F.col("_head"))
        if empty is not None:
            result = F.coalesce(result, empty)
    return joined.withColumn(out, result).drop("_bucket", "_value", "_inner", "_head")
