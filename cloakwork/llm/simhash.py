"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at three differing bits or fewer, so in one of their halves they differ by one bit at most.
In each half the codewords of the Hamming code of length 31 are the anchors: every word is within one bit of an anchor
(the covering radius). A fingerprint is sent to each anchor within two bits of its half, radius plus threshold, 16 at
most; then of two linked fingerprints the nearest anchor of the one is among the anchors of the other. The 32nd bit of a half is
left out, which can only add comparisons. Fingerprints are compared by anchor, over all 64 bits.

Only distinct fingerprints are compared, and an anchor emits a spanning star for each group that it finds, not all pairs.
An anchor that is crowded is cut into a grid of cells: each pair of slices meets in one cell.

Null and blank texts have fingerprint zero and link like any other. A null id never becomes a component's id unless its
component has no other. Repeated rows give repeated result rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.components import components
from cloakwork.llm.texts import NULL_ID, id_and_keys, raw_texts, signed, small_batches
from cloakwork.plans.stored import stored

SHINGLE = 3
SEED = 42
BITS = 3
#: An anchor with more fingerprints than this is cut into cells of about this many.
CELL = 16_384
_PIECE = 1 << 16


def fingerprint(raw: bytes) -> int:
    """SimHash of the lower-cased text's shingles."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PIECE):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _PIECE], ends[at : at + _PIECE])]
        bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a long; and ``t``, the text's hash, if ``hashed``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw) for raw in raw_texts(batch.column(1))], np.uint64)
            t = [batch.column(2)] if hashed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(fps)), *t], ["doc_id", "fp", *["t"] * hashed])

    small_batches(docs)
    t = [id_and_keys(doc_id, text)[1]] if hashed else []
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *t)
    return some.mapInArrow(each, "doc_id long, fp long" + ", t long" * hashed)


def _syndromes() -> np.ndarray:
    """Per value of 16 bits: the exclusive or of the positions (from 0) of its set bits."""
    out = np.zeros(1 << 16, np.uint32)
    for bit in range(16):
        out[1 << bit : 2 << bit] = out[: 1 << bit] ^ np.uint32(bit)
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: for both halves of each fingerprint all codewords within two bits of its low 31 bits.

    Bit ``i`` of a half, from 0, has the Hamming code's position ``i + 1``. The half's number is bit 31 of the anchor.
    """
    table = _syndromes()
    pairs = np.array([[i for i in range(32) if i < i ^ s] for s in range(1, 32)])  # 16 for each syndrome
    flip = np.concatenate([[0], np.uint64(1) << np.arange(31, dtype=np.uint64)]).astype(np.uint64)
    rows, out = [], []
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        up = word << np.uint64(1)  # bit p now has position p
        s = table[(up & np.uint64(0xFFFF)).astype(np.int64)] ^ table[(up >> np.uint64(16)).astype(np.int64)]
        s ^= np.uint32(16) * (np.bitwise_count(up >> np.uint64(16)).astype(np.uint32) & np.uint32(1))
        exact, near = np.flatnonzero(s == 0), np.flatnonzero(s)
        choice = pairs[s[near] - 1]
        code = word[near, None] ^ flip[choice] ^ flip[choice ^ s[near, None].astype(np.int64)]
        rows += [exact, np.repeat(near, 16)]
        out += [a | np.uint64(half << 31) for a in (word[exact], code.ravel())]
    return np.concatenate(rows), np.concatenate(out)


def _stars(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span each set of fingerprints chained together, one comparison row at a time."""
    rest = group
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= BITS
            if near.any():
                found = rest[near]
                yield np.full(len(found), root), found
                todo.extend(found)
                rest = rest[~near]


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell key, fp) sorted by cell: a spanning forest of the links in each cell."""
    left: tuple[np.ndarray, np.ndarray] | None = None
    names = ["u", "v"]

    def links(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.repeat(sizes <= 32, sizes)
        k, f = key[small], fps[small]
        for step in range(1, 32):  # neighbours in their cell, one apart, two apart and so on
            same = k[step:] == k[:-step] if len(k) > step else np.zeros(0, bool)
            if not same.any():
                break
            a, b = f[:-step][same], f[step:][same]
            near = np.bitwise_count(a ^ b) <= BITS
            out.append((a[near], b[near]))
        for i in np.flatnonzero(sizes > 32):
            out += _stars(fps[starts[i] : starts[i] + sizes[i]])
        u = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
        v = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(signed(v))], names)

    for batch in batches:
        key, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fps = fps.view(np.uint64)
        if left is not None:
            key, fps = np.concatenate([left[0], key]), np.concatenate([left[1], fps])
        if not len(key):
            continue
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        left = (key[cut:], fps[cut:])
        if cut:
            yield links(key[:cut], fps[:cut])
    if left is not None and len(left[0]):
        yield links(*left)


def _replicas(fps: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 20_000):
                rows, anchor = anchors(own[at : at + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(own[at : at + 20_000][rows]))], ["anchor", "fp"]
                )

    return fps.mapInArrow(each, "anchor long, fp long")


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints of ``fps(fp)`` that chain together all that are within BITS."""
    replicas = _replicas(fps)
    # which anchors are crowded is estimated on every 16th fingerprint; it decides how the work is laid out, not its result
    some = _replicas(fps.filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(16)) == 0)).groupBy("anchor").count()
    crowded = some.filter(F.col("count") * 16 > cell).select(
        F.col("anchor"), F.ceil(F.col("count") * 16 / cell).cast("long").alias("n")
    )
    dealt = replicas.join(crowded, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    others = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    pair = F.least(own, F.col("other")) * F.col("n") + F.greatest(own, F.col("other"))
    # a cell's key: the anchor of 32 bits, and the cell's number above it
    dealt = dealt.select(
        F.when(F.col("n").isNull(), F.col("anchor")).otherwise(F.col("anchor") + F.shiftleft(pair + 1, 32)).alias("cell"), "fp"
    )
    return dealt.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_cell_links, "u long, v long")


def _classes(fps: DataFrame) -> DataFrame:
    """``fp, component_id`` and ``root``, a fingerprint that stands for the component, of each fingerprint of ``fps(doc_id, fp)``."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp"))).withColumnsRenamed({"node": "fp"})
    # classes: every fingerprint with its root, and the root's smallest id
    of = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(ids, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` in hexadecimal and ``component_id``, the smallest id that links reach."""
    fps = stored(fingerprints(docs, doc_id, text))
    classes = _classes(fps)
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeated: bool = True) -> DataFrame:
    """The document with the smallest id of each component, with all columns. Rows of one id are one document there, and all
    stay; with ``repeated=False`` one of them does, that with the least hash of its text. Of a component whose ids are
    all null one row stays in either case. Rows of an id that lie in another document's component go.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    fps = stored(fingerprints(docs, doc_id, text, hashed=True))
    rows = fps.join(_classes(fps), "fp").filter("doc_id <=> component_id").groupBy("doc_id", "t", "root").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows)
    lone = F.lit(not repeated) | F.col("component_id").isNull()
    least = rows.groupBy("root").agg(F.first("doc_id").alias("component_id"), F.min("t").alias("t")).filter(lone).select("root", "t")
    single = rows.filter(F.lit(not repeated) | F.col("doc_id").isNull()).join(least, ["root", "t"])
    whole = rows.filter(F.lit(repeated) & F.col("doc_id").isNotNull()).unionByName(single.filter("n = 1")).select("doc_id", "t")
    d, t = id_and_keys(doc_id, text)
    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()], d.alias("k_d"), t.alias("k_t"))

    def key(frame: DataFrame) -> DataFrame:
        return frame.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k_d"), F.col("t").alias("k_t"))

    # of rows equal in id and text any one, by an aggregation that begins where the rows lie
    of = given.join(key(single.filter("n > 1")), ["k_d", "k_t"], "left_semi")
    one = of.groupBy("k_d", "k_t").agg(F.first(F.struct(*inner.values())).alias("row")).select("row.*")
    out = given.join(key(whole), ["k_d", "k_t"], "left_semi").select(*inner.values()).unionByName(one)
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()])
