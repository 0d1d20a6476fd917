"""The same operators on Structured Streaming sources.

State is kept per key with a watermark or a timeout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakwork.functions.regex import sql_string
from cloakwork.functions.tokens import TOKEN_JAVA
from cloakwork.operators.audit import append_audit, mask_events
from cloakwork.operators.demask import demask
from cloakwork.operators.mask import mask_table, token_rows
from cloakwork.operators.vault import TTL_SECONDS
from cloakwork.sources.rules import Rule
from cloakwork.sources.tables import masked_output
from cloakwork.streaming import sessions


def read_folder(spark: SparkSession, folder: str, name: str, ts: str | None = None) -> DataFrame:
    """A parquet table of a folder, one file or a folder of files, as a stream; ``ts`` is cast so that it can carry a watermark."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern that only the table's own path fits: a plain path would have to be a folder
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def stream_mask(stream: DataFrame, text: str, session: str, rules: list[Rule] | None = None) -> DataFrame:
    """Masking is stateless, so it is the batch operator. Sessions need a column: random ids would differ
    when a batch is replayed."""
    return mask_table(stream, text, session=session, rules=rules)


def stream_dedup(stream: DataFrame, keys: list[str], ts: str, delay: str = "15 minutes") -> DataFrame:
    """Drop replayed requests; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_sessions(events: DataFrame, ttl: float = TTL_SECONDS, delay: str = "15 minutes") -> DataFrame:
    """See ``sessions.stream_sessions``."""
    return sessions.stream_sessions(events, ttl, delay)


def stream_outcomes(ops: DataFrame, ttl: float = TTL_SECONDS, delay: str = "15 minutes") -> DataFrame:
    """``vault.outcomes`` on a stream of operations ``session_id, ts, op_id, op``; ``late`` ones did not take effect."""
    none = F.lit(None)
    events = ops.select(
        "session_id", "ts", "op_id", "op", none.cast("array<string>").alias("tokens"), none.cast("array<string>").alias("values"),
        none.cast("string").alias("text"),
    )
    return stream_sessions(events, ttl, delay).select("session_id", "ts", "op_id", "op", "done", "late")


def stream_demask(replies: DataFrame, masks: DataFrame, ttl: float = TTL_SECONDS, delay: str = "5 minutes") -> DataFrame:
    """Replies (``reply_id, session_id, ts, text``) restored from their session's map at that moment, one row each.

    ``masks`` are mask events (``session_id, mask_ts, token_map``, and ``op`` where some extend or delete). A reply
    whose session is not live, or that the watermark has passed (``late``), leaves unchanged with ``resolved = false``.
    """
    op = F.col("op") if "op" in masks.columns else F.lit("put")
    puts = masks.select(
        "session_id", F.col("mask_ts").alias("ts"), F.lit(0).cast("long").alias("op_id"), op.alias("op"),
        F.col("token_map.token").alias("tokens"), F.col("token_map.value").alias("values"), F.lit(None).cast("string").alias("text"),
    )
    none = F.lit(None).cast("array<string>")
    asked = replies.select(
        "session_id", "ts", F.col("reply_id").cast("long").alias("op_id"), F.lit("reply").alias("op"),
        none.alias("tokens"), none.alias("values"), "text",
    )
    return restored_replies(stream_sessions(puts.unionByName(asked), ttl, delay))


def restored_replies(sessions: DataFrame) -> DataFrame:
    """The replies among the rows of ``stream_sessions``: ``reply_id, session_id, ts, original_text, entities_restored, resolved, late``."""
    pairs = F.expr("transform(arrays_zip(tokens, values), p -> named_struct('token', p.tokens, 'value', p.values))")
    done = demask(sessions.filter("op = 'reply'").withColumn("pairs", pairs), "text", "pairs")
    return done.select(
        F.col("op_id").alias("reply_id"), "session_id", "ts", "original_text", "entities_restored", F.col("done").alias("resolved"), "late"
    )


def stream_demask_join(replies: DataFrame, masks: DataFrame, ttl: float = TTL_SECONDS, delay: str = "5 minutes") -> DataFrame:
    """Replies restored by a stream-stream interval join, token by token: ``reply_id, session_id, ts, original_text,
    entities_restored, resolved``, one row for each reply once the watermark has passed it.

    ``replies`` has ``reply_id, session_id, ts, text``, ``masks`` (puts alone) ``session_id, mask_ts, token_map``. A row for each token of a reply
    meets the rows of that session and token that are up to ``ttl`` old; a row without a token finds the session's last
    put, and only that put's values count. So state holds single tokens for the time to live, no map is carried, and no Python
    runs. ``reply_id`` tells replies of one session and moment apart. Tokens inside restored values stay as they are.
    Like all joins of streams this one drops rows behind the watermark; ``stream_demask`` gives them back instead.
    State lies on disk, not in the executors' heap: all that the delay and the time to live hold back may be far larger than that.
    """
    sessions.keep_on_disk(replies.sparkSession)
    mark = F.lit("").alias("token")
    tokens = F.expr(f"array_distinct(regexp_extract_all(text, {sql_string(TOKEN_JAVA)}, 0))")
    asked = replies.withWatermark("ts", delay).select(
        "reply_id", F.col("session_id").cast("string").alias("session_id"), "ts", "text", F.explode(F.concat(F.array(mark), F.coalesce(tokens, F.array()))).alias("token")
    )  # the text travels with the row that has no token only
    asked = asked.withColumn("text", F.when(F.col("token") == "", F.col("text")))
    first = F.struct(F.lit("").alias("token"), F.lit(None).cast("string").alias("value"))
    pairs = F.transform(F.coalesce("token_map", F.array()), lambda p: F.struct(p["token"].alias("token"), p["value"].alias("value")))
    held = masks.withWatermark("mask_ts", delay).select(
        F.col("session_id").cast("string").alias("_session"), "mask_ts", F.posexplode(F.concat(F.array(first), pairs)).alias("ord", "p")
    ).select("_session", "mask_ts", "ord", F.col("p.token").alias("_token"), "p.value")
    recent = F.expr(f"mask_ts <= ts AND mask_ts > ts - make_dt_interval(0, 0, 0, {ttl})")
    joined = asked.join(held, (F.col("session_id") == F.col("_session")) & (F.col("token") == F.col("_token")) & recent, "left_outer")
    hit = F.when((F.col("token") != "") & F.col("_token").isNotNull(), F.struct("mask_ts", "ord", "token", "value"))
    whole = joined.groupBy("reply_id", "session_id", "ts").agg(
        F.max("text").alias("text"), F.max(F.when(F.col("token") == "", F.col("mask_ts"))).alias("put"), F.array_sort(F.collect_list(hit)).alias("hits")
    )
    own = F.expr("transform(filter(hits, h -> h.mask_ts = put), h -> named_struct('token', h.token, 'value', h.value))")
    done = demask(whole.withColumn("pairs", own), "text", "pairs")
    return done.select("reply_id", "session_id", "ts", "original_text", "entities_restored", F.col("put").isNotNull().alias("resolved"))


def unresolved(replies: DataFrame) -> DataFrame:
    """The replies that left as they came, to be routed elsewhere."""
    return replies.filter("not resolved")


def audit_windows(events: DataFrame, ts: str, size: str, slide: str | None = None, delay: str = "15 minutes") -> DataFrame:
    """Events per type and tumbling or sliding window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        events.withWatermark(ts, delay)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events")
    )


def session_windows(events: DataFrame, ts: str, session: str, gap: str = "15 minutes", delay: str = "15 minutes") -> DataFrame:
    """Events per session and spell of activity."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), session)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(session, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events")
    )


def write_stream(masked: DataFrame, paths: dict[str, str], checkpoint: str, text: str = "text", key: str = "session_id", **trigger) -> StreamingQuery:
    """Masked rows, then vault rows, then audit events of every micro-batch.

    A batch writes to a folder of its own by its id and overwrites it when replayed, so nothing is doubled.
    The batch is kept while it is written, so that masked text and token rows agree.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            masked_output(batch, text).write.mode("overwrite").parquet(f"{paths['masked']}/batch={batch_id}")
            rows = token_rows(batch, key)
            rows.write.mode("overwrite").parquet(f"{paths['vault']}/batch={batch_id}")
            append_audit(mask_events(rows), f"{paths['audit']}/batch={batch_id}", mode="overwrite")
        finally:
            batch.unpersist()

    return (
        masked.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain(df: DataFrame, folder: str, output_mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read back what it gave. ``complete`` keeps the last batch."""
    spark = df.sparkSession
    out = f"{folder}/out"
    if output_mode == "complete":
        query = (
            df.writeStream.outputMode("complete")
            .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        )
    else:
        query = df.writeStream.outputMode(output_mode).format("parquet").option("path", out)
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
