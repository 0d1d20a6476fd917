"""The state of a stream session: one entry for each token, read and written one token at a time.

``transformWithState`` keeps a session in three variables on RocksDB: a head (when it was last renewed, whether it is live), a
map from token to value, and the rows that wait for the watermark. A reply reads the tokens that it holds, and those that
their values bring forth; a put or an extend writes the tokens it brings. Neither reads or writes the rest of the map. Timers on event
time apply what the watermark has passed and give a session up when its time to live has passed (state TTL proper runs by
the clock, which a replay would not repeat). Rows of timers that are fetched together leave in one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cloakwork.functions.tokens import TOKEN_REGEX

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "us long, op_id long, op string, tokens array<string>, values array<string>, text string"
OUT = "session_id string, us long, op_id long, op string, done boolean, late boolean, text string, tokens array<string>, values array<string>"


def keep_on_disk(spark: SparkSession) -> None:
    """State of the streams that start from now on lies in RocksDB, whose stores share one bounded cache in each executor; a join
    keeps one store for each partition, not four."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


def _processor(to_live: int, token_regex: str) -> StatefulProcessor:
    # made here, so that it travels with the task and workers need not import this package
    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            import re

            self.out = []
            self.find = re.compile(token_regex).findall
            self.handle = handle
            self.head = handle.getValueState("head", "seen long, live boolean, next long, due long")
            self.map = handle.getMapState("map", "token string", "place long, value string")
            self.waiting = handle.getListState("waiting", _EVENT)

        def handleInputRows(self, key, rows, timerValues):
            mark, fresh, late = timerValues.getCurrentWatermarkInMs() * 1000, [], []
            for frame in rows:
                for us, op_id, op, tokens, values, text in zip(*(frame[c] for c in ("us", "op_id", "op", "tokens", "values", "text"))):
                    row = (int(us), int(op_id), op, [] if tokens is None else list(tokens), [] if values is None else list(values), text)
                    (late if us < mark else fresh).append(row)
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(min(r[0] for r in fresh) // 1000 + 1)
            if late:
                yield self.shown([(key[0], us, op_id, op, False, True, text, None, None) for us, op_id, op, _, _, text in late])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs()
            rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[2] == "reply", r[1]))
            ready = [r for r in rows if r[0] < mark * 1000]
            rest = rows[len(ready) :]
            if ready:
                if rest:
                    self.waiting.put(rest)
                    self.handle.registerTimer(rest[0][0] // 1000 + 1)
                else:
                    self.waiting.clear()
            self.out += [(key[0], *r) for r in self.applied(ready, mark)]
            if self.out and not self.more_timers():
                out, self.out = self.out, []
                yield self.shown(out)

        def more_timers(self):
            """Whether timers that were fetched with this one are still to come: then its rows go with theirs, as a frame for each
            session costs far more than its rows. Where that cannot be told, they go at once."""
            return bool(getattr(getattr(self.handle, "_statefulProcessorApiClient", None), "expiry_timer_iterator_cursors", None))

        def applied(self, ready, mark):
            held = self.head.get()
            seen, live, place, due = held or (0, False, 0, 0)
            before = (seen, live, place, due)
            # what this call has read or written of the map, and whether the stored map is void
            self.known, self.dirty, self.void = {}, set(), not live
            out = []
            for us, op_id, op, tokens, values, text in ready:
                lives = live and us - seen < to_live
                if op == "reply":
                    pairs = self.pairs_of(text) if lives and text else []
                    out.append((us, op_id, op, lives, False, text, [p[0] for p in pairs], [p[1] for p in pairs]))
                    continue
                out.append((us, op_id, op, lives or op == "put", False, None, None, None))
                if op == "put" or not lives or op == "delete":
                    self.known, self.dirty, self.void, live, place = {}, set(), True, op == "put", 0
                if op == "put" or (op == "extend" and lives):
                    for token, value in dict(zip(tokens, values)).items():
                        held = self.read(token)
                        self.known[token] = (held[0] if held else place, value)
                        self.dirty.add(token)
                        place += not held
                    seen = us
                elif lives:
                    seen = us
            if live and seen + to_live <= mark * 1000:
                live, self.void, self.dirty = False, True, set()
            if self.void and before[1]:
                self.map.clear()
            for token in self.dirty:
                self.map.updateValue((token,), self.known[token])
            if not live:
                if held:
                    self.head.clear()
                return out
            due = -(-(seen + to_live) // 1000)
            if before != (seen, live, place, due):
                self.head.update((seen, live, place, due))
                if due != before[3]:
                    self.handle.registerTimer(due)
            return out

        def read(self, token):
            if token not in self.known:
                self.known[token] = None if self.void else self.map.getValue((token,))
            return self.known[token]

        def pairs_of(self, text):
            """The session's tokens in a text, and those that restoring it brings to light, in the order of the map."""
            pairs, asked, now = {}, set(), text
            while True:
                fresh = set(self.find(now)) - asked
                asked |= fresh
                held = {t: v for t in fresh if (v := self.read(t))}
                if not held:
                    return sorted(((t, v) for t, (_, v) in pairs.items()), key=lambda p: pairs[p[0]][0])
                pairs.update(held)
                now = text
                for token, (_, value) in sorted(pairs.items(), key=lambda p: p[1][0]):
                    now = now.replace(token, value or "")

        def shown(self, rows):
            import pandas as pd

            names = ["session_id", "us", "op_id", "op", "done", "late", "text", "tokens", "values"]
            return pd.DataFrame(rows, columns=names)

        def close(self) -> None:
            if self.out:
                raise RuntimeError(f"{len(self.out)} rows of sessions were not handed on")

    return Sessions()


def stream_sessions(events: DataFrame, ttl: float, delay: str) -> DataFrame:
    """Operations and replies of sessions, in the order of their times however they arrive.

    ``events`` has ``session_id, ts, op_id, op, tokens, values, text``: puts and extends bring tokens, replies
    (``op = 'reply'``) a text. Rows are held until the watermark has passed them, then applied in order, operations before replies of the
    same moment; the last value written for a token wins. A row that arrives when the watermark has already passed it can no longer
    be put in order: it is not applied and leaves at once, as ``late``. So every row leaves exactly once, with
    ``done`` (for a reply: whether its session is live) and, for a reply, the tokens and values it needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # without the marked column itself, Spark hands late rows on instead of dropping them
    marked = events.withWatermark("ts", delay).select(
        F.col("session_id").cast("string").alias("session_id"), F.unix_micros("ts").alias("us"), "op_id", "op", "tokens", "values", "text"
    )
    processor = _processor(int(ttl * 1_000_000), TOKEN_REGEX)
    out = marked.groupBy("session_id").transformWithStateInPandas(processor, OUT, "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")
