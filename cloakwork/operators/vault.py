"""The session vault: an append-only log of operations and the views on it.

Operations: ``put`` replaces a session's token map, ``extend`` merges into a live one, ``delete`` removes
it. A put or an extend that takes effect restarts the session's time to live; a session whose last such
operation is ``ttl`` seconds old or older is gone, and extending or deleting it does nothing.

Liveness follows from gaps. Cut each session's operations into runs wherever ``ttl`` seconds or more pass
between two of them. Within a run a session is live after a put until a delete; nothing carries over to the
next run. Gaps that long cannot lie inside one ``ttl``-wide time bucket, so runs are found on one
pre-aggregated row per session and bucket. However many operations one session has, no task sees them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.functions.tokens import TOKEN_TYPE_JAVA
from cloakwork.plans.skew import join_hot, running

TTL_SECONDS = 900
OPS = ("put", "extend", "delete")
_RESET = "struct<ts:timestamp,op_id:bigint,op:string>"


def log_rows(df: DataFrame, op: str, ts: str, op_id: str, session: str = "session_id", pairs: str | None = "token_map") -> DataFrame:
    """Log entries for one operation per row of ``df``. An empty map leaves one row without a token."""
    if op not in OPS:
        raise ValueError(f"op must be one of {OPS}")
    head = [
        F.col(session).cast("string").alias("session_id"),
        F.lit(op).alias("op"),
        F.col(op_id).cast("long").alias("op_id"),
        F.col(ts).cast("timestamp").alias("ts"),
    ]
    if op == "delete" or pairs is None:
        none = F.lit(None)
        return df.select(*head, none.cast("int").alias("ord"), none.cast("string").alias("token"), none.cast("string").alias("value"))
    return df.select(*head, F.posexplode_outer(pairs).alias("ord", "p")).select(
        "session_id", "op", "op_id", "ts", "ord", "p.token", "p.value"
    )


def _bucket(ttl: float) -> Column:
    return F.floor(F.unix_micros("ts") / F.lit(int(ttl * 1_000_000)))


def _reset() -> Column:
    return F.when(F.col("op").isin("put", "delete"), F.struct("ts", "op_id", "op"))


def _buckets(log: DataFrame, ttl: float) -> DataFrame:
    """Per session and bucket: first and last operation, last reset, and the start of its run."""
    per = (
        log.withColumn("_b", _bucket(ttl))
        .groupBy("session_id", "_b")
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.max(_reset()).alias("reset"),
        )
    )
    w = Window.partitionBy("session_id").orderBy("_b")
    micros = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(w))
    starts = F.when(micros.isNull() | (micros >= int(ttl * 1_000_000)), F.col("first_ts"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("_starts", starts)
        .withColumn("run_ts", F.max("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("reset_before", F.max("reset").over(before))
        .drop("_starts")
    )


def live_sessions(log: DataFrame, as_of: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """Sessions live at ``as_of``: ``session_id``, the put they date from and their last renewal."""
    runs = _buckets(log.filter(F.col("ts") <= as_of), ttl)
    last = runs.groupBy("session_id").agg(
        F.max("run_ts").alias("run_ts"), F.max("last_ts").alias("last_ts"), F.max("reset").alias("reset")
    )
    age = F.unix_micros(as_of) - F.unix_micros("last_ts")
    return last.filter(
        (F.col("reset.op") == "put") & (F.col("reset.ts") >= F.col("run_ts")) & (age < int(ttl * 1_000_000))
    ).select(
        "session_id",
        F.col("reset.ts").alias("put_ts"),
        F.col("reset.op_id").alias("put_id"),
        "last_ts",
    )


def current(log: DataFrame, as_of: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """The vault at ``as_of``: ``session_id, ord, token, value``, one row per live token.

    The last value written for a token wins; ``ord`` (a struct) gives the place it first appeared in, which
    is the order of the merged map.
    """
    live = live_sessions(log, as_of, ttl).select("session_id", "put_ts", "put_id")
    rows = join_hot(log.filter((F.col("ts") <= as_of) & F.col("token").isNotNull()), live, ["session_id"])
    rows = rows.filter(F.struct("ts", "op_id") >= F.struct(F.col("put_ts").alias("ts"), F.col("put_id").alias("op_id")))
    place = F.struct("ts", "op_id", "ord")
    return rows.groupBy("session_id", "token").agg(
        F.min(place).alias("ord"), F.max_by("value", place).alias("value")
    ).select("session_id", "ord", "token", "value")


def get_sessions(log: DataFrame, wanted: DataFrame, as_of: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """Token rows of the wanted sessions; sessions that are absent or expired have none."""
    chosen = wanted.select("session_id").distinct()
    return current(join_hot(log, chosen, ["session_id"], "left_semi"), as_of, ttl)


def _seen(log: DataFrame, ttl: float) -> DataFrame:
    """One row per operation with ``done`` and the put or delete before it, ``_last``."""
    ops = log.groupBy("session_id", "ts", "op_id", "op").agg(F.count("token").alias("n_tokens"))
    heads = _buckets(log, ttl).select("session_id", "_b", "run_ts", "reset_before")
    order = [F.col("ts"), F.col("op_id")]
    within = Window.partitionBy("session_id", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        ops.withColumn("_b", _bucket(ttl))
        .withColumn("_last", F.max(_reset()).over(within))
        .join(heads, ["session_id", "_b"])
        .withColumn("_last", F.coalesce("_last", "reset_before"))
    )
    live = (F.col("_last.op") == "put") & (F.col("_last.ts") >= F.col("run_ts"))
    return seen.withColumn("done", (F.col("op") == "put") | F.coalesce(live, F.lit(False)))


def outcomes(log: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """One row per operation with ``done``: whether it took effect. A put always does; an extend or a
    delete only if the session is live at that moment."""
    return _seen(log, ttl).select("session_id", "ts", "op_id", "op", "n_tokens", "done")


def merged_maps(log: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """Per extend that took effect: how many tokens the merged map has then, and of which types."""
    now = F.struct("ts", "op_id")
    ops = _seen(log, ttl).filter("done and op <> 'delete'")
    base = F.when(F.col("op") == "put", now).otherwise(F.struct("_last.ts", "_last.op_id"))
    ops = ops.select("session_id", "ts", "op_id", "op", base.alias("base"))
    rows = log.filter("token is not null").select("session_id", "ts", "op_id", "token")
    rows = rows.join(ops.drop("op"), ["session_id", "ts", "op_id"])
    life = ["session_id", "base"]
    kind = F.regexp_extract("token", TOKEN_TYPE_JAVA, 1)
    first = rows.groupBy(*life, "token").agg(F.min(now).alias("at"), F.first(kind).alias("kind"))
    new = first.groupBy(*life, "at").agg(F.count(F.lit(1)).alias("n"))
    # types are few, so their list is small whatever the session's size
    kinds = first.groupBy(*life, "kind").agg(F.min("at").alias("at")).groupBy(*life).agg(
        F.array_sort(F.collect_list(F.struct("kind", "at"))).alias("kinds")
    )
    so_far = Window.partitionBy(*life).orderBy("ts", "op_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = ops.withColumn("at", now).join(new, [*life, "at"], "left").withColumn("token_count", F.sum("n").over(so_far))
    joined = joined.filter("op = 'extend'").join(kinds, life, "left")
    known = F.filter("kinds", lambda k: k["at"] <= F.struct("ts", "op_id"))
    return joined.select(
        "session_id", "ts", "op_id", F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.transform(F.coalesce(known, F.array()), lambda k: k["kind"]).alias("token_types"),
    )


def expired_sessions(log: DataFrame, as_of: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """Sessions whose last state was live but has outlived ``ttl`` by ``as_of``, with the moment it ended."""
    runs = _buckets(log.filter(F.col("ts") <= as_of), ttl)
    w = Window.partitionBy("session_id").orderBy("_b")
    # the state at the end of each run; a later run replaces it
    ends = runs.withColumn("_next", F.lead("run_ts").over(w)).filter(
        F.col("_next").isNull() | (F.col("_next") > F.col("run_ts"))
    )
    last = F.coalesce("reset", "reset_before")
    ends = ends.withColumn("_reset", last).filter(
        (F.col("_reset.op") == "put") & (F.col("_reset.ts") >= F.col("run_ts"))
    )
    ended = F.timestamp_micros(F.unix_micros("last_ts") + int(ttl * 1_000_000))
    return ends.select("session_id", ended.alias("expired_ts")).filter(F.col("expired_ts") <= as_of)


def active_sessions(log: DataFrame, as_of: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """How many sessions are live."""
    return live_sessions(log, as_of, ttl).agg(F.count(F.lit(1)).alias("active_sessions"))


def number_conversation(findings: DataFrame, conversation: str, turn: str, chunk: int = 4096) -> DataFrame:
    """Add ``n``: numbering that runs on over the turns of a conversation, per type.

    Numbering each turn from 1 would let a later turn's tokens overwrite an earlier turn's on extend.
    """
    bucket = F.floor(F.col(turn) / chunk)
    order = [F.col(turn), F.col("start"), F.col("pos")]
    out = running(findings, [conversation, "entity_type"], bucket, order, F.lit(1), "n")
    return out.withColumn("n", F.col("n") + 1)
