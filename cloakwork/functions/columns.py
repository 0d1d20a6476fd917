"""Keeping an expensive column computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, sql: str | Column, out: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add column ``out``, computed once however it is used later.

    A filter on a plain computed column is pushed below it with the whole computation copied into the
    filter. It is not pushed through a generated column, while filters on the other columns still reach
    the scan; so the value is generated as the one element of an array.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in drop]
    return df.select(*keep, F.explode_outer(F.array(F.expr(sql) if isinstance(sql, str) else sql)).alias(out))
