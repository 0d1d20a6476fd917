"""Physical expiry: the vault's log by day, snapshots of what lives, and reads that touch no older day.

    <root>/log/day=2024-01-09/            every operation of a day, as ``vault.log_rows`` gives them
    <root>/snapshot/heads/day=2024-01-10/ a row for each session that was live when that day began
    <root>/snapshot/tokens/day=2024-01-10/ a row for each of its tokens

A snapshot is made from the one before it and the days between the two, never from the whole log, and holds only live
sessions; ``retire`` then deletes the days and snapshots that it stands in for. What has outlived its time to live is thus gone from disk
after the next compaction.

A head stands in for its session's past as a put at the moment of the last renewal: an operation that follows within the time to
live finds the session live, a later one does not, just as in the full log. Tokens keep the places where they first and last appeared, so
that merged maps have the same order and the last value wins.

Writing a day's snapshot again replaces it, so a job that was interrupted can be repeated; only snapshots that were completed are read.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.vault import TTL_SECONDS, live_sessions
from cloakwork.plans.skew import join_hot
from cloakwork.plans.stored import stored

_PLACE = "struct<ts:timestamp,op_id:bigint,ord:int>"
LOG = "session_id string, op string, op_id bigint, ts timestamp, ord int, token string, value string, day date"
HEADS = "session_id string, put_ts timestamp, put_id bigint, last_ts timestamp"
TOKENS = f"session_id string, token string, value string, first {_PLACE}, last {_PLACE}"


def append(rows: DataFrame, root: str) -> None:
    """Add operations to the log, each to its day."""
    rows = rows.withColumn("ord", F.col("ord").cast("int")).withColumn("day", F.to_date("ts"))
    rows.select(*(part.split()[0] for part in LOG.split(", "))).repartition("day", F.pmod(F.xxhash64("session_id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(f"{root}/log")


def _paths(spark: SparkSession, folder: str) -> list[tuple[date, str]]:
    """The days below a folder, with their paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted((date.fromisoformat(p.getName()[4:]), p.toString()) for p in found if p.getName().startswith("day="))


def snapshots(spark: SparkSession, root: str) -> list[date]:
    """Days with a complete snapshot; tokens are written after heads."""
    out = []
    for day, path in _paths(spark, f"{root}/snapshot/tokens"):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            out.append(day)
    return out


def _since(spark: SparkSession, root: str, before: date | None) -> tuple[DataFrame, DataFrame, DataFrame, date | None]:
    """The last snapshot that is no later than ``before``, and the log from its day on."""
    known = [d for d in snapshots(spark, root) if before is None or d <= before]
    base = known[-1] if known else None
    log = spark.read.schema(LOG).parquet(f"{root}/log")
    if base is None:
        return spark.createDataFrame([], HEADS), spark.createDataFrame([], TOKENS), log, None
    heads = spark.read.schema(HEADS).parquet(f"{root}/snapshot/heads/day={base}")
    tokens = spark.read.schema(TOKENS).parquet(f"{root}/snapshot/tokens/day={base}")
    return heads, tokens, log.filter(F.col("day") >= F.lit(base)), base


def _stand_ins(heads: DataFrame) -> DataFrame:
    none = F.lit(None)
    return heads.select(
        "session_id", F.lit("put").alias("op"), F.col("put_id").alias("op_id"), F.col("last_ts").alias("ts"),
        none.cast("int").alias("ord"), none.cast("string").alias("token"), none.cast("string").alias("value"),
    )


def _state(heads: DataFrame, tokens: DataFrame, log: DataFrame, as_of: Column, ttl: float) -> tuple[DataFrame, DataFrame]:
    """Heads and tokens at ``as_of``, from those of a snapshot and the operations since."""
    log = log.drop("day").filter(F.col("ts") <= as_of)
    live = stored(live_sessions(_stand_ins(heads).unionByName(log), as_of, ttl))
    # sessions that no put has replaced since the snapshot: their put is the stand-in
    old = heads.select("session_id", F.col("put_ts").alias("_put_ts"), F.col("last_ts").alias("put_ts"), "put_id")
    joined = live.join(old, ["session_id", "put_ts", "put_id"], "left")
    carried = stored(joined.filter("_put_ts is not null").select("session_id"))
    new_heads = joined.select("session_id", F.coalesce("_put_ts", "put_ts").alias("put_ts"), "put_id", "last_ts")
    kept = join_hot(tokens, carried, ["session_id"], "left_semi")
    place = F.struct("ts", "op_id", "ord").cast(_PLACE)
    since = F.struct(F.col("put_ts").alias("ts"), F.col("put_id").alias("op_id"))
    added = join_hot(log.filter("token is not null"), live.select("session_id", "put_ts", "put_id"), ["session_id"])
    added = added.filter(F.struct("ts", "op_id") >= since).select("session_id", "token", "value", place.alias("first"), place.alias("last"))
    merged = kept.unionByName(added).groupBy("session_id", "token").agg(
        F.max_by("value", "last").alias("value"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return new_heads, merged


def compact(spark: SparkSession, root: str, day: date, ttl: float = TTL_SECONDS) -> None:
    """Write the snapshot of the moment ``day`` begins."""
    heads, tokens, log, base = _since(spark, root, day)
    if base == day:
        return
    begins = F.timestamp_micros(F.unix_micros(F.lit(day).cast("timestamp")) - 1)
    new_heads, merged = _state(heads, tokens, log.filter(F.col("day") < F.lit(day)), begins, ttl)
    # heads first: a snapshot counts once its tokens are complete
    new_heads.write.mode("overwrite").parquet(f"{root}/snapshot/heads/day={day}")
    merged.write.mode("overwrite").parquet(f"{root}/snapshot/tokens/day={day}")


def current(spark: SparkSession, root: str, as_of: Column, day: date, ttl: float = TTL_SECONDS) -> DataFrame:
    """``vault.current`` at ``as_of``, a moment of ``day`` or later: reads one snapshot and the log from its day on."""
    heads, tokens, log, _ = _since(spark, root, day)
    _, merged = _state(heads, tokens, log, as_of, ttl)
    return merged.select("session_id", F.col("first").alias("ord"), "token", "value")


def retire(spark: SparkSession, root: str, day: date) -> int:
    """Delete the log's days and the snapshots before ``day``, which must have a snapshot itself. How many were deleted."""
    if day not in snapshots(spark, root):
        raise ValueError(f"there is no complete snapshot of {day}")
    old = [p for part in ("log", "snapshot/tokens", "snapshot/heads") for d, p in _paths(spark, f"{root}/{part}") if d < day]
    for place in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)
