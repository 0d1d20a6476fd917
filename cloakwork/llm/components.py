"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.plans.stored import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node ties its neighbours to the smallest of them and itself: the larger ones (large star), or the
    smaller ones and itself (small star). The smallest comes from a partial aggregation, so hubs gather nowhere."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # edges run from the larger node u to the smaller v
    # stored, so that the join shares no shuffle with the aggregation and can be split where a node has many neighbours
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if small:
        own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is linked to (``root``), for every node of ``links(u, v)`` but the roots.

    Links may point either way, repeat, or join a node to itself. The number of rounds grows with the logarithm of the
    largest component's width; each round's links are written to the shared folder.
    """
    edges = stored(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).alias("s")
    before = edges.agg(mark).first()["s"]
    while before["n"]:
        edges = stored(_star(stored(_star(edges, small=False)), small=True))
        now = edges.agg(mark).first()["s"]
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
