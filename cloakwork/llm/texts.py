"""Texts as bytes in Arrow batches, word hashes, and Spark settings shared by the operators here.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``: exactly what ``bytes.split()`` returns. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ID = -(2**63)
TEXTS_PER_BATCH = 2000
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(docs: DataFrame) -> None:
    """Whole texts are large rows: have Spark hand fewer of them at a time to Python than of others. And have the code there."""
    from cloakwork.llm.shipping import ship

    ship(docs.sparkSession)
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > TEXTS_PER_BATCH:
        conf.set(key, str(TEXTS_PER_BATCH))


def id_and_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """``d``, a null id as the smallest long, and ``t``, which tells rows with one id but different texts apart."""
    return (
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)).alias("d"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("t"),
    )


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``d``, ``t`` (see ``id_and_keys``) and ``text``, null as empty; whatever else ``docs`` has is left behind."""
    small_batches(docs)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    return docs.select(*id_and_keys(doc_id, text), whole)


def public_id(column: str = "d") -> Column:
    """``d`` as it was given."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, without decoding them."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return (bytes(view[a:b]) for a, b in zip(at, at[1:]))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return values.view(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            step = len(self.up)
            for name, base in (("up", self.base), ("down", self.inverse)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, step, 2**64))]))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of values times powers; ``spans`` turns differences of them into hashes."""
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the values of each span, the same wherever the span lies."""
        return (prefix[ends] - prefix[starts]) * self.down[starts]


BYTES = Powers(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A long text is hashed in pieces of about so many bytes, which bounds the tables of powers.
PIECE = 1 << 20


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    hashes, at = [], 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        low = starts[at]
        prefix = BYTES.prefix(data[low : ends[stop - 1]].astype(np.uint64) + np.uint64(1))
        hashes.append(mixed(BYTES.spans(prefix, starts[at:stop] - low, ends[at:stop] - low)))
        at = stop
    return starts, ends, hashes[0] if len(hashes) == 1 else np.concatenate(hashes)
