"""Packing examples into sequences: vector bin packing by the dot-product heuristic.

An example loads a sequence in three ways at once: tokens, segments (one each) and loss-bearing tokens. A sequence is
filled by always adding the example that fits and whose load, in shares of the limits, has the largest dot product with
the room left; the shares are weighed by how scarce each limit is over all examples. Examples are dealt by a hash of
their content and row number into blocks of some thousands, so that equal rows are spread, too; each block is packed alone, so
nothing grows with the table but the number of blocks.

If examples may be cut, a sequence that nothing fits any more is topped up with the head of the largest example left, unless the
gap is under ``MIN_PIECE`` tokens, and the last, partly filled sequence of a block is cut into sequences whose lengths are powers of two, which need no
padding. Otherwise sequences end where they end.

An example longer than the token limit is cut in both modes. A limit of loss-bearing tokens applies to whole examples
only where they are not cut. Null texts are empty: one token, the end id. Null ids stay null, repeated rows are packed
one by one, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shipping import ship
from cloakwork.llm.texts import id_and_text, public_id
from cloakwork.llm.tokens import Vocabulary
from cloakwork.plans.stored import stored

CAPACITY = 2048
MAX_SEGMENTS = 256
#: A sequence of conversations: tokens, how many of them, tokens of answers.
DIALOGUE = 8192
CONVERSATIONS = 8
ANSWERED = 6144
MIN_PIECE = 16
#: Examples packed together.
BLOCK = 4096


class _Stock:
    """Examples by load; those of equal load are interchangeable, and the one given last is taken first."""

    def __init__(self, loads: np.ndarray, limits: np.ndarray):
        self.limits = limits
        self.held: dict[tuple, list] = {}
        for i, load in enumerate(map(tuple, loads.tolist())):
            self.held.setdefault(load, []).append((i, 0))
        self.loads = np.array(sorted(self.held), np.int64).reshape(-1, loads.shape[1])
        self.count = np.array([len(self.held[tuple(x)]) for x in self.loads.tolist()], np.int64)
        scarce = loads.sum(axis=0) / limits
        self.shares = self.loads / limits * (scarce / max(scarce.sum(), 1e-9))
        self.left = len(loads)

    def best(self, room: np.ndarray) -> int:
        """The load with the largest dot product among those that fit; -1 if none does."""
        fits = (self.count > 0) & (self.loads <= room).all(axis=1)
        if not fits.any():
            return -1
        return int(np.argmax(np.where(fits, self.shares @ (room / self.limits), -1.0)))

    def take(self, k: int) -> tuple:
        self.count[k] -= 1
        self.left -= 1
        return self.held[tuple(self.loads[k].tolist())].pop()

    def put(self, load: tuple, piece: tuple) -> None:
        self.left += 1
        at = self.held.setdefault(load, [])
        at.append(piece)
        k = np.flatnonzero((self.loads == load).all(axis=1))
        if len(k):
            self.count[k[0]] += 1
            return
        weight = self.shares.max(axis=0) / np.maximum(self.loads.max(axis=0) / self.limits, 1e-12)
        self.loads = np.vstack([self.loads, load])
        self.count = np.append(self.count, 1)
        self.shares = np.vstack([self.shares, np.array(load) / self.limits * weight])


def pack(tokens: np.ndarray, loss: np.ndarray | None, capacity: int, segments: int, max_loss: int | None, cut: bool) -> list[tuple]:
    """Sequences of examples: a tuple ``(example, start, length, sequence, offset)`` for each piece.

    ``loss`` counts each example's loss-bearing tokens; where examples are cut, every token but a piece's first bears loss.
    """
    limits = np.array([capacity, segments, max_loss or capacity], np.int64)
    tokens = np.asarray(tokens, np.int64)
    own = np.maximum(tokens - 1, 0) if cut or loss is None else np.minimum(loss, limits[2])
    stock = _Stock(np.stack([tokens, np.ones_like(tokens), own], axis=1), limits)
    out: list[tuple] = []
    sequence = 0
    while stock.left:
        room, offset, held = limits.copy(), 0, []
        while stock.left:
            k = stock.best(room)
            if k >= 0:
                load = stock.loads[k]
                example, start = stock.take(k)
                n = int(load[0])
            else:
                # every token but a piece's first bears loss, so that limit also bounds the piece
                n = int(min(room[0], room[2] + 1))
                if not cut or n < MIN_PIECE or room[1] < 1:
                    break
                k = int(np.argmax(np.where(stock.count > 0, stock.loads[:, 0], -1)))
                whole = int(stock.loads[k][0])
                if whole <= n:
                    break
                example, start = stock.take(k)
                stock.put((whole - n, 1, whole - n - 1), (example, start + n))
                load = np.array([n, 1, n - 1])
            held.append((example, start, n, offset))
            offset += n
            room = room - load
        # closed by the end of the block, or by the limit on segments
        if cut and offset < capacity and (not stock.left or room[1] < 1):
            sequence = _powers(held, sequence, out)
        else:
            out += [(e, s, n, sequence, o) for e, s, n, o in held]
            sequence += 1
    return out


def _powers(held: list[tuple], sequence: int, out: list[tuple]) -> int:
    """Cut a partly filled sequence into sequences whose lengths are powers of two."""
    total = sum(n for _, _, n, _ in held)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    offset = 0
    for example, start, n, _ in held:
        while n:
            piece = min(n, sizes[0] - offset)
            out.append((example, start, piece, sequence, offset))
            start, n, offset = start + piece, n - piece, offset + piece
            if offset == sizes[0]:
                sizes, sequence, offset = sizes[1:], sequence + 1, 0
    return sequence


def pack_examples(
    examples: DataFrame,
    example_id: str,
    tokens: str,
    loss_tokens: str,
    capacity: int = CAPACITY,
    segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
) -> DataFrame:
    """Whole examples of known size (instruction data): ``example_id, length, loss_tokens, sequence_id, offset``.

    Null sizes count as zero. An example over a limit by itself gets a sequence of its own, cut down by nobody.
    """
    ship(examples.sparkSession)
    # stored, so that a row keeps its number
    rows = stored(examples.select(
        F.col(f"`{example_id}`").alias("example_id"),
        F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)).alias("length"),
        F.coalesce(F.col(f"`{loss_tokens}`").cast("long"), F.lit(0)).alias("loss_tokens"),
        F.monotonically_increasing_id().alias("row"),
    ))
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("example_id", "length", "loss_tokens", "row"), F.lit(blocks))).drop("row")
    kind = rows.schema["example_id"].dataType.simpleString()

    def each(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "loss_tokens"], kind="stable").reset_index(drop=True)
        over = (block.length > capacity) | (block.loss_tokens > (max_loss or capacity))
        fits = np.flatnonzero(~over)
        packed = pack(block.length[fits].to_numpy(), block.loss_tokens[fits].to_numpy(), capacity, segments, max_loss, cut=False)
        rows = [(fits[e], s, o) for e, _, _, s, o in packed]
        rows += [(e, len(packed) + i, 0) for i, e in enumerate(np.flatnonzero(over))]
        at = [r[0] for r in rows]
        out = block.loc[at, ["example_id", "length", "loss_tokens"]].reset_index(drop=True)
        out["sequence_id"] = [(int(block.block.iloc[0]) << 32) + r[1] for r in rows]
        out["offset"] = [r[2] for r in rows]
        return out

    return rows.groupBy("block").applyInPandas(
        each, f"example_id {kind}, length long, loss_tokens long, sequence_id long, offset long"
    )


def pack_conversations(
    turns: DataFrame,
    vocabulary: Vocabulary,
    conversation: str = "conv_id",
    role: str = "role",
    text: str = "text",
    answering: str = "assistant",
    capacity: int = DIALOGUE,
    segments: int = CONVERSATIONS,
    max_loss: int = ANSWERED,
) -> DataFrame:
    """Whole conversations under all three limits: ``conversation, length, loss_tokens, sequence_id, offset``.

    A turn counts its ids and an end id, and bears loss if its role is ``answering``; a null text is empty, a null role bears
    none, and turns without a conversation count as one. Turns are counted where they lie; only the counts are shuffled.
    """
    given = turns.select(
        F.col(f"`{conversation}`").alias("c"),
        F.coalesce(F.col(f"`{role}`") == answering, F.lit(False)).alias("answer"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    kind = given.schema["c"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                ids = encoder.encode(batch.column(2).to_pylist())
                n = np.array([len(x) // encoder.kind.itemsize + 1 for x in ids], np.int64)
                loss = np.where(batch.column(1).to_numpy(zero_copy_only=False), n, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(loss)], ["c", "n", "loss"])

    ship(turns.sparkSession)
    counted = given.mapInArrow(count, f"c {kind}, n long, loss long")
    sums = counted.groupBy("c").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    packed = pack_examples(sums, "c", "n", "loss", capacity, segments, max_loss)
    return packed.withColumnRenamed("example_id", conversation)


def pack_documents(
    docs: DataFrame,
    vocabulary: Vocabulary,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    segments: int = MAX_SEGMENTS,
    with_ids: bool = False,
) -> DataFrame:
    """Whole texts as pieces of sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and
    ``ids``, the piece's ids as an array, if asked for.

    A text's ids are tokenized where it lies. Its stretches of ``capacity`` ids are sequences already; only the rest is dealt
    into blocks and packed. ``docs`` should come from files: a row keeps its number then when a task is run again.
    """
    texts = id_and_text(docs, doc_id, text)
    blocks = max(1, -(-docs.count() // BLOCK))
    rows = texts.withColumn("block", F.pmod(F.xxhash64("d", "t", F.monotonically_increasing_id()), F.lit(blocks))).select("block", "d", "t", "text")
    names = ["block", "d", "t", "doc_tokens", "start", "length", "crc", "ids"]
    kinds = "block long, d long, t long, doc_tokens long, start long, length long, crc long, ids binary"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        end = np.array([vocabulary.end], encoder.kind).tobytes()
        width = encoder.kind.itemsize
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                keys = [c.to_pylist() for c in batch.columns[:3]]
                out = []
                for i, ids in enumerate(encoder.encode(batch.column(3).to_pylist())):
                    ids += end
                    n = len(ids) // width
                    for start in range(0, n, capacity):
                        piece = ids[start * width : (start + capacity) * width]
                        full = len(piece) == capacity * width
                        crc = _crc(np.frombuffer(piece, encoder.kind)) if full else None
                        held = piece if with_ids or not full else None
                        out.append((keys[0][i], keys[1][i], keys[2][i], n, start, len(piece) // width, crc, held))
                kinds_ = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_)], names)

    wide = "array<int>"

    def place(block: pd.DataFrame) -> pd.DataFrame:
        kind = vocabulary.encoder().kind
        block = block.sort_values(["d", "t", "start"], kind="stable").reset_index(drop=True)
        full = block.length.to_numpy() == capacity
        rest = np.flatnonzero(~full)
        columns = {c: block[c].tolist() for c in ("d", "start", "doc_tokens", "crc", "ids")}
        base = int(block.block.iloc[0]) << 32
        out, sequence = [], 0
        for i in np.flatnonzero(full).tolist():
            ids = np.frombuffer(columns["ids"][i], kind) if with_ids else None
            out.append((columns["d"][i], columns["start"][i], capacity, int(columns["crc"][i]), columns["doc_tokens"][i], base + sequence, 0, ids))
            sequence += 1
        for e, start, n, at, offset in pack(block.length.to_numpy()[rest], None, capacity, segments, None, cut=True):
            i = rest[e]
            ids = np.frombuffer(columns["ids"][i], kind)[start : start + n]
            row = (columns["d"][i], columns["start"][i] + start, n, _crc(ids), columns["doc_tokens"][i], base + sequence + at, offset)
            out.append((*row, ids if with_ids else None))
        frame = pd.DataFrame(out, columns=["d", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        frame["ids"] = [None if x is None else x.astype(np.int32) for x in frame["ids"]]
        return frame

    packed = rows.mapInArrow(tokenize, kinds).groupBy("block").applyInPandas(
        place, f"d long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids {wide}"
    )
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return packed.select(public_id().alias("doc_id"), *columns)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
