"""Streams against their batch counterparts, with late, repeated and out-of-order input."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cloakwork.operators import vault
from cloakwork.operators.mask import mask_table
from cloakwork.streaming import streams

START = datetime(2024, 1, 1)


def stream_of(spark, df, folder, name, parts):
    """Files that are read one micro-batch each."""
    import time

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/p{i}")
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/{name}")


def test_outcomes_in_batches_same_as_in_one(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in range(300):
        rows.append((rng.choice("abc"), START + timedelta(seconds=i * 40 + rng.randint(0, 30)), i, rng.choice(["put", "extend", "extend", "delete"])))
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, op_id long, op string")
    last = spark.createDataFrame([("z", START + timedelta(days=9), 999, "put")], df.schema)
    in_order = [df.filter((F.col("op_id") >= k) & (F.col("op_id") < k + 100)) for k in (0, 100, 200)]
    mixed = [df.filter(F.col("op_id") % 3 == k) for k in (1, 0, 2)]
    got = []
    for name, parts, delay in (("ordered", in_order, "15 minutes"), ("mixed", mixed, "1 day")):
        out = streams.stream_outcomes(stream_of(spark, df, tmp_path, name, [*parts, last]), 300, delay)
        got.append({r.op_id: r.done for r in streams.drain(out, str(tmp_path / f"o{name}")).filter("session_id <> 'z'").collect()})
    log = df.withColumn("token", F.lit("t"))
    want = {r.op_id: r.done for r in vault.outcomes(log, 300).collect()}
    assert got == [want, want]


def test_late_reply_is_not_restored(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.com"), (2, "c@d.com")], "doc_id long, text string")
    at = F.lit(START).cast("timestamp")
    masks = mask_table(df, session="doc_id").select("session_id", "token_map", at.alias("mask_ts"))
    replies = mask_table(df, session="doc_id").select(
        F.col("doc_id").alias("reply_id"), "session_id", F.col("masked_text").alias("text"),
        F.when(F.col("doc_id") == 1, at + F.expr("interval 899 seconds")).otherwise(at + F.expr("interval 900 seconds")).alias("ts"),
    )
    # a last pair far ahead moves both watermarks past the others
    later = at + F.expr("interval 1 day")
    masks2 = masks.limit(1).select(F.lit("z").alias("session_id"), "token_map", later.alias("mask_ts"))
    replies2 = replies.limit(1).select(F.lit(9).cast("long").alias("reply_id"), F.lit("z").alias("session_id"), "text", later.alias("ts"))
    ms = stream_of(spark, masks, tmp_path, "m", [masks, masks2])
    rs = stream_of(spark, replies, tmp_path, "r", [replies, replies2])
    rows = {r.reply_id: r for r in streams.drain(streams.stream_demask(rs, ms), str(tmp_path / "o")).collect()}
    assert rows[1].resolved and rows[1].original_text == "a@b.com"
    assert not rows[2].resolved and rows[2].original_text.startswith("{{__OWL:") and rows[2].entities_restored == 0


def test_last_map_wins_and_extends_merge(spark, tmp_path):
    a, b = "{{__OWL:A_1__}}", "{{__OWL:B_1__}}"
    schema = "session_id string, ts timestamp, op_id long, op string, tokens array<string>, values array<string>, text string"
    t = lambda s: START + timedelta(seconds=s)
    rows = [
        ("s", t(0), 1, "put", [a], ["old"], None), ("s", t(100), 2, "put", [a], ["new"], None), ("s", t(200), 3, "extend", [b], ["more"], None),
        ("s", t(150), 10, "reply", None, None, f"{a} {b}"), ("s", t(250), 11, "reply", None, None, f"{a} {b}"), ("s", t(50), 12, "reply", None, None, a),
        ("s", t(1100), 13, "reply", None, None, a), ("s", t(300), 4, "delete", None, None, None), ("s", t(310), 14, "reply", None, None, a),
        ("z", t(99_999), 99, "put", [], [], None),
    ]
    df = spark.createDataFrame(rows, schema)
    parts = [df.filter(F.col("op_id").isin(11, 2, 13, 4)), df.filter(F.col("op_id").isin(1, 3, 10, 12, 14)), df.filter("op_id = 99")]
    out = streams.restored_replies(streams.stream_sessions(stream_of(spark, df, tmp_path, "e", parts), 900, "1 hour"))
    got = {r.reply_id: (r.original_text, r.entities_restored, r.resolved) for r in streams.drain(out, str(tmp_path / "o")).collect()}
    assert got == {12: ("old", 1, True), 10: (f"new {b}", 1, True), 11: ("new more", 2, True), 14: (a, 0, False), 13: (a, 0, False)}


def test_replayed_requests_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, START + timedelta(seconds=i)) for i in range(20)], "request_id long, ts timestamp")
    out = streams.stream_dedup(stream_of(spark, df, tmp_path, "d", [df, df]), ["request_id"], "ts")
    assert sorted(r.request_id for r in streams.drain(out, str(tmp_path / "o")).collect()) == [0, 1, 2, 3, 4]


def test_batches_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.com"), (2, "no"), (3, "c@d.com 123-45-6789")], "doc_id long, text string")
    masked = streams.stream_mask(stream_of(spark, df, tmp_path, "d", [df.filter("doc_id < 2"), df.filter("doc_id >= 2")]), "text", "doc_id")
    paths = {k: str(tmp_path / f"out_{k}") for k in ("masked", "vault", "audit")}
    streams.write_stream(masked, paths, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(paths["masked"]).count() == 3
    assert "text" not in spark.read.parquet(paths["masked"]).columns
    assert spark.read.parquet(paths["vault"]).count() == 3
    assert {r.session_id: r.token_count for r in spark.read.parquet(paths["audit"]).collect()} == {"1": 1, "3": 2}


EVENTS = "session_id string, ts timestamp, op_id long, op string, tokens array<string>, values array<string>, text string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_rows_behind_the_watermark_are_given_back(spark, tmp_path):
    a = "{{__OWL:A_1__}}"
    rows = [
        ("s", at(0), 1, "put", [a], ["x"], None), ("s", at(10), 10, "reply", None, None, a), ("t", at(5000), 2, "put", [a], ["y"], None),
        # the watermark stands at 4400 s when these come
        ("s", at(20), 11, "reply", None, None, a), ("u", at(30), 12, "reply", None, None, a), ("u", at(30), 3, "put", [a], ["z"], None),
        (None, at(40), 13, "reply", None, None, None), ("t", at(5010), 14, "reply", None, None, a), ("z", at(99_999), 99, "put", [], [], None),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    parts = [df.filter("op_id in (1, 10, 2)"), df.filter("op_id in (11, 12, 3, 13, 14)"), df.filter("op_id = 99")]
    every = streams.drain(streams.stream_sessions(stream_of(spark, df, tmp_path, "e", parts), 900, "10 minutes"), str(tmp_path / "o"))
    got = {r.op_id: (r.done, r.late) for r in every.filter("op_id <> 99").collect()}
    assert got == {1: (True, False), 10: (True, False), 2: (True, False), 14: (True, False)} | dict.fromkeys((11, 12, 3, 13), (False, True))
    replies = {r.reply_id: (r.original_text, r.resolved) for r in streams.restored_replies(every).collect()}
    assert replies == {10: ("x", True), 14: ("y", True), 11: (a, False), 12: (a, False), 13: (None, False)}


def test_a_reply_reads_and_writes_no_more_than_its_tokens(spark, tmp_path):
    tokens = [f"{{{{__OWL:A_{i}__}}}}" for i in range(1, 3001)]
    values = [f"v{i}" for i in range(1, 2999)] + [f"[{tokens[4]}]", f"<{tokens[2998]}>"]
    # a value that holds a later token is restored further, one that holds an earlier token is not
    asked = f"{tokens[9]} {tokens[2998]} {tokens[2999]}"
    replies = [("s", at(100 + i), 10 + i, "reply", None, None, asked) for i in range(20)]
    rows = [("s", at(0), 1, "put", tokens, values, None), *replies, ("s", at(200), 50, "put", tokens[:1], ["new"], None), ("s", at(210), 51, "reply", None, None, asked + tokens[0]), ("z", at(99_999), 99, "put", [], [], None)]
    df = spark.createDataFrame(rows, EVENTS)
    parts = [df.filter("op_id = 1"), df.filter("op_id between 2 and 40"), df.filter("op_id between 41 and 60"), df.filter("op_id = 99")]
    out = streams.stream_sessions(stream_of(spark, df, tmp_path, "e", parts), 900, "1 second")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in map(lambda p: __import__("json").loads(p.json), query.recentProgress)]
    assert max(written) >= 3000 and sum(n >= 3000 for n in written) == 1 and sorted(written)[-2] < 100
    done = {r.op_id: r for r in spark.read.parquet(f"{tmp_path}/out").filter("op = 'reply'").collect()}
    assert all(len(r.tokens) <= 4 for r in done.values())
    texts = {r.reply_id: r.original_text for r in streams.restored_replies(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert texts[15] == f"v10 [{tokens[4]}] <{tokens[2998]}>" and texts[51] == asked + "new"


def test_interval_join_of_tokens(spark, tmp_path):
    a, b = "{{__OWL:A_1__}}", "{{__OWL:B_1__}}"
    kind = "session_id string, mask_ts timestamp, token_map array<struct<token:string,value:string>>"
    masks = [("s", at(0), [(a, "one"), (b, "two")]), ("s", at(100), [(a, "new")]), ("q", at(0), None), ("z", at(99_999), [])]
    replies = [
        (1, "s", at(50), f"{a} {b} {a}"), (2, "s", at(150), f"{a} {b}"), (3, "s", at(999), a), (4, "s", at(1000), a), (5, "none", at(10), a), (6, "s", at(60), "plain"),
        (7, "s", at(70), None), (8, "q", at(10), a), (9, "s", at(100), a), (10, None, at(10), a), (99, "z", at(99_999), a),
    ]
    ms = spark.createDataFrame(masks, kind)
    rs = spark.createDataFrame(replies, "reply_id long, session_id string, ts timestamp, text string")
    left = stream_of(spark, rs, tmp_path, "r", [rs.filter("reply_id % 2 = 0"), rs.filter("reply_id % 2 = 1 and reply_id < 99"), rs.filter("reply_id = 99")])
    right = stream_of(spark, ms, tmp_path, "m", [ms.filter("mask_ts < '2024-01-01 00:01:00'"), ms.filter("mask_ts between '2024-01-01 00:01:00' and '2024-01-01 01:00:00'"), ms.filter("session_id = 'z'")])
    out = streams.stream_demask_join(left, right, 900, "1 hour")
    got = sorted((r.reply_id, r.original_text, r.entities_restored, r.resolved) for r in streams.drain(out, str(tmp_path / "o")).collect())
    want = [
        (1, "one two one", 2, True), (2, f"new {b}", 1, True), (3, "new", 1, True), (4, a, 0, False), (5, a, 0, False), (6, "plain", 0, True),
        (7, None, 0, True), (8, a, 0, True), (9, "new", 1, True), (10, a, 0, False),
    ]
    assert [g for g in got if g[0] != 99] == want


def test_sessions_of_timers_that_came_together_leave_together():
    """Against states in memory: a frame for each session, as it was before, cost far more than its rows."""
    from types import SimpleNamespace

    import pytest

    from cloakwork.streaming import sessions

    waiting, now = {k: [(5, k, "put", ["t"], ["v"], None), (6, k, "reply", [], [], "t")] for k in range(3)}, SimpleNamespace(key=None)
    left = {}
    nothing = SimpleNamespace(get=lambda: None)
    rows = SimpleNamespace(get=lambda: iter(waiting[now.key]), clear=lambda: waiting.pop(now.key))
    handle = SimpleNamespace(
        getValueState=lambda *_: nothing, getMapState=lambda *_: nothing, getListState=lambda *_: rows, _statefulProcessorApiClient=SimpleNamespace(expiry_timer_iterator_cursors=left)
    )
    processor, times = sessions._processor(1000, "t"), SimpleNamespace(getCurrentWatermarkInMs=lambda: 99)
    processor.init(handle)

    def fired(key, *more):
        now.key = key
        left.clear()
        left.update(dict.fromkeys(more))
        return list(processor.handleExpiredTimer((str(key),), times, None))

    assert fired(0, "more") == [] and fired(1, "more") == []
    with pytest.raises(RuntimeError):
        processor.close()
    (frame,) = fired(2)
    assert [(r.session_id, r.op, r.done, r.late) for r in frame.itertuples()] == [(str(k), op, True, False) for k in range(3) for op in ("put", "reply")]
    processor.close()
    # where the timers still to come cannot be told, rows go at once
    waiting[0], handle._statefulProcessorApiClient = [(5, 0, "put", ["t"], ["v"], None)], None
    (frame,) = fired(0, "more")
    assert len(frame) == 1


def test_the_join_of_tokens_keeps_its_state_out_of_the_heap(spark, tmp_path):
    a = "{{__OWL:A_1__}}"
    masks = spark.createDataFrame([("s", at(0), [(a, "one")]), ("z", at(99_999), [])], "session_id string, mask_ts timestamp, token_map array<struct<token:string,value:string>>")
    replies = spark.createDataFrame([(1, "s", at(50), a), (99, "z", at(99_999), a)], "reply_id long, session_id string, ts timestamp, text string")
    left = stream_of(spark, replies, tmp_path, "r", [replies.filter("reply_id = 1"), replies.filter("reply_id = 99")])
    right = stream_of(spark, masks, tmp_path, "m", [masks.filter("session_id = 's'"), masks.filter("session_id = 'z'")])
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = streams.stream_demask_join(left, right, 900, "1 hour")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [o for p in query.recentProgress for o in __import__("json").loads(p.json)["stateOperators"]]
    assert {o["operatorName"] for o in kept} == {"symmetricHashJoin", "stateStoreSave"}
    assert all(any(name.startswith("rocksdb") for name in o["customMetrics"]) for o in kept)
    # one store for each partition of the join, not four
    assert all(o["numStateStoreInstances"] == o["numShufflePartitions"] for o in kept)
    assert {r.reply_id: r.original_text for r in spark.read.parquet(f"{tmp_path}/out").collect()}[1] == "one"
