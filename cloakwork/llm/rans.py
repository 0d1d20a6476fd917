"""Token ids in files coded by a range asymmetric numeral system with static tables.

A table of frequencies, counted over all ids and scaled to a power of two, is shared by all files. Ids are cut into
blocks that are coded on their own: ``LANES`` interleaved coders take the ids in turn, so that one NumPy step codes one
id of each lane. A file holds its blocks, then an index: where each document's ids lie, and for each block its place in the file, its first id and two checksums,
of its bytes and of its ids. So any block can be decoded alone, and files are written and read by as many tasks.

File, little-endian: ``MAGIC``; blocks; documents (id and number of ids, 64 bits each); checkpoints (``CHECKPOINT``);
number of documents, number of blocks, place of the documents, checksum of the index (64 bits each).
Block: number of lanes (64 bits), the lanes' final states (64 bits each), words of 32 bits in the order in which decoding needs them.

Documents lie in ascending id order, null ids first; a null text is its end id alone; repeated rows are written one by
one; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.files import each_file, id_bounds, opened, range_of, starts, width, written
from cloakwork.llm.texts import id_and_text, public_id
from cloakwork.llm.tokens import Vocabulary
from cloakwork.plans.stored import stored, work_folder

MAGIC = b"RANS0001"
BITS = 18
LANES = 4096
BLOCK = 1 << 20
CHECKPOINT = np.dtype([("place", "<i8"), ("bytes", "<i8"), ("first", "<i8"), ("ids", "<i8"), ("crc", "<i8"), ("ids_crc", "<i8")])
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_MASK = np.uint64((1 << BITS) - 1)


class Table:
    """Frequencies that add up to ``2 ** BITS``, at least one for each id that occurs."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> Table:
        counts = counts.astype(np.int64)
        used = counts > 0
        free = (1 << BITS) - int(used.sum())
        if free < 0:
            raise ValueError(f"more than 2 ** {BITS} different ids")
        total = int(counts.sum())
        out = np.where(used, 1 + np.array([int(c) * free // max(total, 1) for c in counts.tolist()]), 0)
        if total:
            out[int(np.argmax(counts))] += (1 << BITS) - int(out.sum())
        return Table(out)

    def save(self, uri: str) -> None:
        raw = self.frequencies.astype("<u4").tobytes()
        with written(uri) as out:
            out.write(MAGIC + zlib.crc32(raw).to_bytes(8, "little") + raw)

    @staticmethod
    def load(uri: str) -> Table:
        with opened(uri) as file:
            data = file.read()
        if data[:8] != MAGIC or zlib.crc32(data[16:]) != int.from_bytes(data[8:16], "little"):
            raise ValueError(f"{uri} is damaged")
        return Table(np.frombuffer(data, "<u4", offset=16))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """A block: lanes in turn, the last id first."""
    lanes = max(1, min(LANES, len(ids) // 64))
    state = np.full(lanes, _LOW)
    limit = table.frequencies << np.uint64(63 - BITS)
    words: list[np.ndarray] = []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        step = ids[at : at + lanes]
        x, f = state[: len(step)], table.frequencies[step]
        full = x >= limit[step]
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> _32, x)
        q = x // f
        state[: len(step)] = (q << np.uint64(BITS)) + (x - q * f) + table.before[step]
    return lanes.to_bytes(8, "little") + state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, table: Table) -> np.ndarray:
    """The ``n`` ids of a block."""
    lanes = int.from_bytes(data[:8], "little")
    state = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 + 8 * lanes)
    out, used = np.empty(n, np.uint32), 0
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        slot = x & _MASK
        ids = table.slots[slot.astype(np.int64)]
        out[at : at + len(x)] = ids
        x = table.frequencies[ids] * (x >> np.uint64(BITS)) + slot - table.before[ids]
        short = np.flatnonzero(x < _LOW)
        if len(short):
            x[short] = (x[short] << _32) | words[used : used + len(short)].astype(np.uint64)
            used += len(short)
        state[: len(x)] = x
    return out


def write_file(uri: str, documents: Iterator[tuple[int, np.ndarray]], table: Table) -> tuple[int, int]:
    """Write documents ``(id, ids)`` as they come, a block in memory at a time. Their number, and that of their ids."""
    docs: list[tuple[int, int]] = []
    points: list[tuple] = []
    held: list[np.ndarray] = []
    waiting = first = 0
    with written(uri) as out:
        out.write(MAGIC)

        def block(ids: np.ndarray) -> None:
            nonlocal first
            data = encode_block(ids, table)
            points.append((out.tell(), len(data), first, len(ids), zlib.crc32(data), zlib.crc32(ids.astype("<u4").tobytes())))
            out.write(data)
            first += len(ids)

        for d, ids in documents:
            docs.append((d, len(ids)))
            held.append(ids)
            waiting += len(ids)
            if waiting >= BLOCK:
                joined = np.concatenate(held)
                whole = waiting - waiting % BLOCK
                for at in range(0, whole, BLOCK):
                    block(joined[at : at + BLOCK])
                held, waiting = [joined[whole:]], waiting - whole
        if waiting:
            block(np.concatenate(held))
        place = out.tell()
        index = np.array(docs, "<i8").tobytes() + np.array(points, CHECKPOINT).tobytes()
        out.write(index + np.array([len(docs), len(points), place, zlib.crc32(index)], "<i8").tobytes())
    return len(docs), first


def read_index(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Documents (id, number of ids) and checkpoints of a file."""
    with opened(uri) as file:
        size = file.size()
        n, k, place, crc = np.frombuffer(file.read_at(32, size - 32), "<i8").tolist()
        index = file.read_at(size - 32 - place, place)
        if file.read_at(8, 0) != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{uri} is damaged")
    return np.frombuffer(index, "<i8", 2 * n).reshape(n, 2), np.frombuffer(index, CHECKPOINT, k, 16 * n)


def read_block(file: pa.NativeFile, point: np.void, table: Table) -> np.ndarray:
    """One block, by its checkpoint."""
    data = file.read_at(int(point["bytes"]), int(point["place"]))
    if zlib.crc32(data) != point["crc"]:
        raise ValueError("a block's bytes are damaged")
    ids = decode_block(data, int(point["ids"]), table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != point["ids_crc"]:
        raise ValueError("a block decodes to other ids")
    return ids


def read_documents(uri: str, table: Table) -> Iterator[tuple[int, np.ndarray]]:
    """Documents of a file in order, with a block and a document in memory at a time."""
    docs, points = read_index(uri)
    with opened(uri) as file:
        ids, blocks = np.zeros(0, np.uint32), iter(points)
        for d, n in docs.tolist():
            parts, missing = [], n
            while missing > len(ids):
                parts.append(ids)
                missing -= len(ids)
                ids = read_block(file, next(blocks), table)
            parts.append(ids[:missing])
            ids = ids[missing:]
            yield d, parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_corpus(docs: DataFrame, vocabulary: Vocabulary, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole texts and write them below ``folder`` in ascending id order: ``path, part, n_docs, n_ids``.

    Texts are tokenized once, into a table of ids sorted by range. The table of frequencies has a row for each id of the
    vocabulary at most, which is what the driver gets to see of it.
    """
    n = width(docs)
    behind = max(1, n // 8)  # as there are more tasks with more ranges, none of these parts outgrows a task
    bounds = id_bounds(docs, n, doc_id, text)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        end = np.array([vocabulary.end], encoder.kind).tobytes()
        counts = np.zeros(encoder.size, np.int64)
        names = ["part", "d", "t", "ids"]
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                part = range_of(batch.column(0).to_numpy(), bounds)
                ids = [x + end for x in encoder.encode(batch.column(2).to_pylist())]
                for some in ids if sum(map(len, ids)) > 1 << 25 else [b"".join(ids)]:
                    counts += np.bincount(np.frombuffer(some, encoder.kind), minlength=encoder.size)
                yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns[:2], pa.array(ids, pa.binary())], names)
        # and one row more from each task, in one of the parts behind all ranges: how often it has seen each id
        more = [pa.array([n + TaskContext.get().partitionId() % behind], pa.int32()), pa.array([0]), pa.array([0]), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(more, names)

    rows = id_and_text(docs, doc_id, text).mapInArrow(tokenize, "part int, d long, t long, ids binary")
    # one file of the table for each range
    rows = stored(rows.repartitionById(n + behind, F.col("part")).sortWithinPartitions("d", "t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, "<i8")
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    seen = rows.filter(F.col("part") >= n).select("ids")
    found = seen.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in found], default=0) + 1, np.int64)
    counts[[r["id"] for r in found]] = [r["n"] for r in found]
    tables = f"{folder}/frequencies.bin"
    Table.scaled(counts).save(tables)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, table = vocabulary.encoder().kind, Table.load(tables)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                with opened(source) as file:
                    held = pq.ParquetFile(file)
                    if not held.metadata.num_rows:
                        continue
                    part = next(held.iter_batches(1, columns=["part"])).column(0)[0].as_py()
                    if part >= n:
                        continue
                    path = f"{folder}/part-{part:06d}.rans"
                    documents = (
                        (d, np.frombuffer(ids, kind))
                        for some in held.iter_batches(500, columns=["d", "ids"])
                        for d, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist())
                    )
                    row = (path, part, *write_file(path, documents, table))
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "n_docs", "n_ids"), row))])

    return stored(each_file(rows, rows.inputFiles()).mapInArrow(encode, "path string, part long, n_docs long, n_ids long"))


def read_corpus(files: DataFrame, folder: str) -> DataFrame:
    """Read the files back: ``doc_id, start`` (ids before the document's), ``n_tokens, ids_crc32``."""
    tables = f"{folder}/frequencies.bin"
    listed = [(path, before) for path, _, _, _, before in starts(files.select("path", "part", "n_docs", "n_ids"), "part", "n_ids")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.load(tables)
        names = ["d", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for d, ids in read_documents(path, table):
                    rows.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    out = each_file(files, listed).mapInArrow(decode, "d long, start long, n_tokens long, ids_crc32 long")
    return out.select(public_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared storage and read the files back."""
    folder = work_folder(docs.sparkSession)
    return read_corpus(write_corpus(docs, vocabulary, folder, doc_id, text), folder)
