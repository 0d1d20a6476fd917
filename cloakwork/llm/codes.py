"""Vector codes: parts of vectors as numbers of codebook entries, by per-dimension value dictionaries.

A component ``x`` is taken as the integer ``floor(scale * x)``; vectors are cut into equal consecutive parts, and every
part position has a codebook. Vectors are held in blocks. A block has, for each dimension, the distinct integers that
occur in it (its dictionary) and each vector's place in that; so a round tabulates the squared differences of each of
these integers to all entries once, and the distance of a part to all entries is gathered from the tables by place and
added up. A block's tables are bounded by its rows, whatever the values are. A round is one job whose tasks give sums
and counts for each entry; the driver sees the codebooks only.

All arithmetic is on integers and exact: 32 or 64 bits where the block's largest difference allows it, else Python's.

What counts: vectors that are not null and hold no null, NaN or infinite component. Vectors are expected to have one
width, a multiple of ``parts``: the commonest such width of the table (the larger on ties). Others have a null code and
error and take no part in anything else. Null ids come after all others; among rows of one id the smaller integers come
first. Repeated rows count as often as they occur. Fewer vectors than entries make a smaller codebook, and an
empty table gives an empty result. Further columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.texts import small_batches
from cloakwork.plans.skew import join_hot
from cloakwork.plans.stored import stored

#: Vectors in a block, and how many of them are looked at a time.
BLOCK = 4096
_PART = 256
#: Sums travel in rows of so many positions.
_SLICE = 16
_FIRST = "struct<last:boolean,id:bigint,v:array<decimal(38,0)>>"


@dataclass(frozen=True)
class Shape:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


@dataclass
class Codebooks:
    """``books[part, entry, position]``, as 64-bit integers or Python's."""

    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel()).encode()).hexdigest()


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` for finite numbers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    exact = np.array([int(x) if np.isfinite(x) else (int(v) * scale) for x, v in zip(scaled.ravel(), values.astype(np.float64).ravel())], object)
    return exact.reshape(values.shape)


class Block:
    """Vectors as places in the dictionaries of their dimensions."""

    def __init__(self, values: np.ndarray | None = None):
        if values is not None:
            pairs = [np.unique(values[:, j], return_inverse=True) for j in range(values.shape[1])]
            self.words, self.places = [p[0] for p in pairs], np.stack([p[1].ravel() for p in pairs], 1).astype(np.uint16)

    def packed(self) -> tuple[bytes, list[int], bytes]:
        """Dictionaries one after the other, their sizes, and the places. The first byte tells 64-bit numbers from written-out ones."""
        flat = np.concatenate(self.words)
        words = b"8" + flat.astype("<i8").tobytes() if flat.dtype != object else b"," + b",".join(b"%d" % x for x in flat.tolist())
        return words, [len(w) for w in self.words], np.ascontiguousarray(self.places.T).tobytes()

    @classmethod
    def unpacked(cls, words: bytes, sizes: list[int], places: bytes) -> Block:
        out = cls()
        ends = np.cumsum([0, *sizes])
        if words[:1] == b"8":
            flat = np.frombuffer(words, "<i8", offset=1)
        else:
            flat = np.array([int(x) for x in words[1:].split(b",")], object)
        out.words = [flat[a:b] for a, b in zip(ends, ends[1:])]
        out.places = np.frombuffer(places, np.uint16).reshape(len(sizes), -1).T
        return out

    def values(self, columns: range) -> np.ndarray:
        return np.stack([self.words[j][self.places[:, j]] for j in columns], 1)

    def nearest(self, books: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector's part, the first on ties, and the squared distance."""
        width = books.shape[2]
        low = part * width
        dims = range(low, low + width)
        most = max((max(abs(int(self.words[j][i]) - int(b)) for i in (0, -1) for b in (books[part, :, j - low].min(), books[part, :, j - low].max())) for j in dims), default=0)
        bound = most * most * width
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
        tables = []
        for j in dims:
            gap = self.words[j][:, None] - books[part, :, j - low][None, :]
            tables.append((gap * gap).astype(kind))
        n = len(self.places)
        code, least = np.zeros(n, np.int64), np.zeros(n, np.int64 if kind is not object else object)
        for at in range(0, n, _PART):
            rows = self.places[at : at + _PART]
            far = tables[0][rows[:, low]]
            for j in dims[1:]:
                far += tables[j - low][rows[:, j]]
            best = far.argmin(axis=1)
            code[at : at + _PART], least[at : at + _PART] = best, far[np.arange(len(best)), best]
        return code, least


_BLOCKS = "width int, low {first}, ids array<bigint>, labels array<{label}>, words binary, sizes array<int>, places binary"


def blocks(vectors: DataFrame, shape: Shape, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The vectors that count, in stored blocks. ``low`` is a block's first vector; a width that does not divide is negative."""
    small_batches(vectors)
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").alias("label")
    ).filter("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as double))")
    kind = rows.schema["label"].dataType.simpleString()
    schema = _BLOCKS.format(first=_FIRST, label=kind)
    parts, scale = shape.parts, shape.scale

    def block(ids: pa.Array, labels: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        n, width = values.shape
        if width == 0 or width % parts:
            held, width, low = (b"", [], b""), -width - 1, None
        else:
            ints = integers(values, scale)
            held = Block(ints).packed()
            given = ids.to_pylist()
            i = min(range(n), key=lambda i: (given[i] is None, given[i] or 0, ints[i].tolist()))
            # longer numbers than a decimal has are of no use as a first vector's order, and sort as the longest
            low = {"last": given[i] is None, "id": given[i], "v": [max(-(10**38) + 1, min(10**38 - 1, int(x))) for x in ints[i]]}
        spread = pa.array([0, n], pa.int32())
        low_kind = pa.struct([("last", pa.bool_()), ("id", pa.int64()), ("v", pa.list_(pa.decimal128(38, 0)))])
        columns = [
            pa.array([width], pa.int32()), pa.array([low], low_kind), pa.ListArray.from_arrays(spread, ids), pa.ListArray.from_arrays(spread, labels),
            pa.array([held[0]], pa.binary()), pa.array([held[1]], pa.list_(pa.int32())), pa.array([held[2]], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["width", "low", "ids", "labels", "words", "sizes", "places"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def give(width: int) -> pa.RecordBatch:
            ids, labels, values = zip(*held.pop(width))
            return block(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(values))

        for batch in batches:
            ids, lists, labels = batch.columns
            widths = np.array(lists.value_lengths().to_pylist(), np.int64)
            for width in np.unique(widths).tolist():
                at = pa.array(np.flatnonzero(widths == width))
                own, own_ids, own_labels = lists.take(at), ids.take(at), labels.take(at)
                values = own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
                for low in range(0, len(at), BLOCK):
                    some = slice(low, low + BLOCK)
                    held.setdefault(width, []).append((own_ids[some], own_labels[some], values[some]))
                    if sum(len(x[0]) for x in held[width]) + BLOCK > 2 * BLOCK:
                        yield give(width)
            while len(held) > 64:  # many widths: none is held for long
                yield give(next(iter(held)))
        for width in list(held):
            yield give(width)

    return stored(rows.mapInArrow(make, schema))


def first_vectors(held: DataFrame, shape: Shape) -> np.ndarray:
    """The vectors with the smallest ids. Each of the blocks that begin lowest has one at least, so no other block is read."""
    k, scale = shape.entries, shape.scale
    cut = held.select("low").orderBy("low").limit(k).agg(F.max("low").alias("low")).first()
    if cut is None or cut["low"] is None:
        return np.zeros((0, 0), np.int64)
    low = cut["low"]
    numbers = F.array(*[F.lit(str(x)).cast("decimal(38,0)") for x in low["v"]])
    edge = F.struct(F.lit(low["last"]).alias("last"), F.lit(low["id"]).cast("bigint").alias("id"), numbers.alias("v")).cast(_FIRST)
    some = held.filter(F.col("low") <= edge).select("ids", "words", "sizes", "places")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.unpacked(row["words"], row["sizes"], row["places"])
                values, ids = block.values(range(len(row["sizes"]))), row["ids"]
                best = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, values[i].tolist()))[:k]
                yield pa.RecordBatch.from_pylist(
                    [{"last": ids[i] is None, "id": ids[i], "v": [str(x) for x in values[i].tolist()]} for i in best],
                    pa.schema([("last", pa.bool_()), ("id", pa.int64()), ("v", pa.list_(pa.string()))]),
                )

    near = some.mapInArrow(smallest, "last boolean, id bigint, v array<string>")
    order = F.transform("v", lambda x: F.when(F.length(x) < 39, x.cast("decimal(38,0)")))
    rows = near.orderBy("last", "id", order).limit(k).collect()
    ints = [[int(x) for x in r["v"]] for r in rows]
    # the order above is that of integers up to 38 digits; the driver has few enough rows to settle longer ones
    ints = [v for _, v in sorted(((r["last"], r["id"] or 0), v) for r, v in zip(rows, ints))]
    small = max((abs(x) for v in ints for x in v), default=0) < 2**62
    return np.array(ints, np.int64 if small else object)


def _round(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the mean of the parts nearest to it, rounded down; an entry that none is nearest to stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        part_sums = np.zeros((parts, entries, width), np.int64)
        large = False
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.unpacked(row["words"], row["sizes"], row["places"])
                for p in range(parts):
                    code, _ = block.nearest(books, p)
                    values = block.values(range(p * width, (p + 1) * width))
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    counts[p] += np.bincount(code, minlength=entries)
                    if values.dtype == object or np.abs(values).max(initial=0) > 2**44:
                        large = True
                        total[p, used] += np.add.reduceat(values[order].astype(object), starts, axis=0)
                    else:
                        part_sums[p, used] += np.add.reduceat(values[order], starts, axis=0)
        out = []
        whole = total + part_sums if large else part_sums
        for p, e in zip(*np.nonzero(counts)):
            for at in range(0, width, _SLICE):
                own = whole[p, e, at : at + _SLICE].tolist()
                out.append((int(p), int(e), at, int(counts[p, e]), [str(x) for x in own] + ["0"] * (_SLICE - len(own))))
        names, kinds = ["part", "entry", "at", "n", "s"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = held.select("words", "sizes", "places").mapInArrow(sums, "part int, entry int, at int, n bigint, s array<string>")
    added = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(_SLICE)]
    new = books.copy()
    for r in rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), *added).collect():
        for i in range(min(_SLICE, width - r["at"])):
            new[r["part"], r["entry"], r["at"] + i] = int(r[f"s{i}"]) // r["n"]
    return new


def fit(held: DataFrame, shape: Shape) -> Codebooks:
    """Codebooks from ``blocks`` of one width."""
    first = first_vectors(held, shape)
    if not len(first):
        return Codebooks(np.zeros((shape.parts, 0, 0), np.int64))
    width = first.shape[1] // shape.parts
    books = np.stack([first[:, p * width : (p + 1) * width] for p in range(shape.parts)])
    for _ in range(shape.rounds):
        books = _round(held, books)
    return Codebooks(books)


def encode(held: DataFrame, codebooks: Codebooks, width: int) -> DataFrame:
    """``vec_id, code, error, label`` of every vector in the blocks; code and error are null where the width is another."""
    books = codebooks.books
    label = held.schema["labels"].dataType.elementType.simpleString()
    digits = max(2, (books.shape[1] - 1).bit_length() + 3 >> 2)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column(1)[i].values, batch.column(2)[i].values
                row = {name: batch.column(name)[i].as_py() for name in ("width", "words", "sizes", "places")}
                codes, errors = [None] * len(ids), [None] * len(ids)
                if row["width"] == width:
                    block = Block.unpacked(row["words"], row["sizes"], row["places"])
                    found = [block.nearest(books, p) for p in range(len(books))]
                    codes = ["".join(f"{c:0{digits}x}" for c in own) for own in zip(*(f[0].tolist() for f in found))]
                    errors = [str(sum(own)) for own in zip(*(f[1].tolist() for f in found))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.string()), pa.array(errors, pa.string()), labels], ["vec_id", "code", "error", "label"])

    found = held.mapInArrow(each, f"vec_id bigint, code string, error string, label {label}")
    # distances that pass 64 bits are given as the largest number there is
    return found.withColumn("error", F.when(F.col("error").isNotNull(), F.coalesce(F.expr("try_cast(error as bigint)"), F.lit(2**63 - 1))))


def report(vectors: DataFrame, shape: Shape = Shape(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: ``vec_id, code, error, label_error, codebooks_sha256, label``. ``label_error`` is the error summed over
    equal labels, nulls together; sums that pass 64 bits are given as the largest number there is."""
    held = blocks(vectors, shape, vec_id, vector, label)
    widths = held.filter("width >= 0").groupBy("width").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else -1
    codebooks = fit(held.filter(F.col("width") == width), shape)
    rows = stored(encode(held.select("width", "ids", "labels", "words", "sizes", "places"), codebooks, width))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stored(rows.groupBy(F.col("label").alias("_label")).agg(F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error")))
    # a null label is an own key beside the label, which plain joins can split where one label has most rows
    keyed = rows.withColumns({"_none": F.col("label").isNull(), "_key": F.coalesce(F.hash("label"), F.lit(0))})
    sums = sums.withColumns({"_none": F.col("_label").isNull(), "_key": F.coalesce(F.hash("_label"), F.lit(0))})
    joined = join_hot(keyed, sums, ["_none", "_key"]).filter(F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"), "label")
