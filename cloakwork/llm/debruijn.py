"""Repeated passages by compaction of the De Bruijn graph of words.

The graph's edges are windows of ``WIDTH`` words, its nodes what neighbouring windows share. No row is made for every
edge: a run of windows with one least core (see ``runs``) is a path, and it is dropped if its core lies in one document
only. The paths left are compacted in two ways:

* Paths that share a core but differ lie where the graph branches. Those from the first document that has them are
  taken apart into single edges, for which the first document is looked up.
* Paths that share their core with no other are followed along the documents. Where a path is always followed by one
  and the same path, which always follows it, both become one. A join gives every occurrence what its path knows of its
  neighbours, and as such a compact path lies whole in every document that has part of it, its pieces are
  put together document by document.

A compact path that lies in an earlier document too is a repeated span. Paths are held equal by 128-bit hashes of their
words. That is verified: every span keeps the place of its path in the first document, the whole span is read back there
and at its own place, and it counts only if both have the same words, by a second, cryptographic hash.

Null texts have no words. Null ids sort before all others and stay null. Rows that share an id remove nothing from each
other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.runs import by_document, covered, keyed, live_runs, numbers, word_units
from cloakwork.llm.texts import id_and_text, public_id, raw_texts
from cloakwork.plans.stored import discard, stored

WIDTH = 13
CORE = 4
_KEY = "g1 long, g2 long, core long, d long, t long, at long, n int"
_READ = "g1 long, g2 long, d long, t long, at long, n long, s1 long, s2 long, edge boolean"


def _places(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each of them starts and ends there."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate([[0], ends[:-1] + 1]), ends


def _hashes(places: tuple[bytes, np.ndarray, np.ndarray], at: np.ndarray, size: np.ndarray | int, digest: Callable[[bytes], bytes]) -> np.ndarray:
    """128-bit hashes, two longs each, of the ``size`` words from ``at`` on."""
    joined, starts, ends = places
    spans = zip(starts[at].tolist(), ends[at + size - 1].tolist())
    return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)


def _witness(words: bytes) -> bytes:
    """What a span's words are compared by when they are read back."""
    return hashlib.blake2b(words, digest_size=16).digest()


def _batches(held: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Tuples of equally long arrays as batches of some 200,000 rows."""
    names, waiting, rows = [c.split()[0] for c in schema.split(", ")], [], 0
    for columns in held:
        waiting.append(columns)
        rows += len(columns[0])
        if rows > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting)], names)
            waiting, rows = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting)], names)


def _paths(texts: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The runs with a 128-bit hash ``g1, g2`` of their words, read from the text."""
    joined = texts.join(by_document(runs, ["k"], "core", "at", "n"), "k").select("d", "t", "text", "parts")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            fields = {f: numbers(batch.column(3), f) for f in ("core", "at", "n")}
            ids, ts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, raw in enumerate(raw_texts(batch.column(2))):
                words = raw.split()
                at, n, core = (fields[f][i].astype(np.int64) for f in ("at", "n", "core"))
                order = np.unique(at * (width + 1) + n, return_index=True)[1]
                # those of another row with this key may reach beyond this text
                order = order[at[order] + n[order] + width - 1 <= len(words)]
                at, n, core = at[order], n[order], core[order]
                if len(at):
                    g = _hashes(_places(words), at, n + width - 1, xxhash.xxh3_128_digest)
                    yield g[:, 0], g[:, 1], core, np.full(len(at), ids[i]), np.full(len(at), ts[i]), at, n.astype(np.int32)

    return joined.mapInArrow(lambda batches: _batches(hashed(batches), _KEY), _KEY)


def _read_back(texts: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Spans read again where they lie, ``s1, s2`` the witness of their words; and, with ``edge``, the single edges of those
    at a branch, ``g1, g2`` the hash of theirs."""
    joined = texts.join(by_document(spans, ["d", "t"], "g1", "g2", "at", "n", "fork"), ["d", "t"]).select("d", "t", "text", "parts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            fields = {f: numbers(batch.column(3), f) for f in ("g1", "g2", "at", "n", "fork")}
            ids, ts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, raw in enumerate(raw_texts(batch.column(2))):
                words = raw.split()
                g1, g2, at, n, fork = (fields[f][i] for f in ("g1", "g2", "at", "n", "fork"))
                inside = at + n + width - 1 <= len(words)
                g1, g2, at, n, fork = (c[inside] for c in (g1, g2, at, n, fork))
                if not len(at):
                    continue
                places = _places(words)
                s = _hashes(places, at, n + width - 1, _witness)
                own = (np.full(len(at), ids[i]), np.full(len(at), ts[i]), at, n)
                yield g1, g2, *own, s[:, 0], s[:, 1], np.zeros(len(at), bool)
                first, n = at[fork.astype(bool)], n[fork.astype(bool)]
                if len(first):
                    of = np.repeat(np.arange(len(n)), n)
                    at = np.unique(first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
                    g, none = _hashes(places, at, width, xxhash.xxh3_128_digest), np.zeros(len(at), np.int64)
                    own = (np.full(len(at), ids[i]), np.full(len(at), ts[i]), at, none + 1)
                    yield g[:, 0], g[:, 1], *own, none, none, np.ones(len(at), bool)

    return joined.mapInArrow(lambda batches: _batches(read(batches), _READ), _READ)


def compact(paths: DataFrame) -> DataFrame:
    """Compact paths of the stored ``paths(g1, g2, core, d, t, at, n)``, which is given up: rows ``g1, g2, d, t, at, n,
    first, fork``, occurrence by occurrence.

    ``g1, g2`` is the hash of a compact path's first piece, and so the same wherever it lies; ``first`` is the least document
    that has the path. Rows with ``fork`` lie at a branch and are left as they were.
    """
    along = Window.partitionBy("d", "t").orderBy("at", "n")
    end = F.col("at") + F.col("n")
    # repeated rows give their paths again
    once = paths.withColumn("twin", (F.lag("at").over(along) == F.col("at")) & (F.lag("n").over(along) == F.col("n")))
    once = once.filter("twin is null or not twin")
    steps = once.withColumn("before", F.when(F.lag(end).over(along) == F.col("at"), F.lag("g1").over(along)))
    steps = steps.withColumn("after", F.when(F.lead("at").over(along) == end, F.lead("g1").over(along)))
    steps = stored(steps.select("g1", "g2", "core", "d", "t", "at", "n", "before", "after"))
    discard(paths)
    # of each path: its first document, and whether its neighbours are always the same
    known = steps.groupBy("g1", "g2", "core").agg(
        F.min("d").alias("first"),
        F.max("d").alias("last"),
        *[((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))).alias(f"one_{c}") for c in ("before", "after")],
    )
    forks = steps.groupBy("core").agg(F.min("g1").alias("low"), F.max("g1").alias("high")).filter("low < high")
    known = known.join(forks.select("core", F.lit(True).alias("fork")), "core", "left")
    # only what lies in several documents, or at a branch, can be part of a repeated span
    known = known.withColumn("fork", F.col("fork").isNotNull()).filter("first < last or fork").drop("core", "last")
    steps_of = steps.select("g1", "g2", "d", "t", "at", "n").join(known, ["g1", "g2"])
    same = F.lag("one_after").over(along) & F.col("one_before") & (F.lag(end).over(along) == F.col("at"))
    same = same & ~F.col("fork") & ~F.lag("fork").over(along) & (F.lag("first").over(along) == F.col("first"))
    path = F.sum(F.when(same, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    whole = steps_of.withColumn("path", path).groupBy("d", "t", "path").agg(
        *[F.min_by(g, "at").alias(g) for g in ("g1", "g2")],
        *[F.min("at").alias("at"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("fork").alias("fork")],
    )
    out = stored(whole.select("g1", "g2", "d", "t", "at", "n", "first", "fork"))
    discard(steps)
    return out


def repeated_spans(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``d, t, at, n, first, first_t, first_at, s1, s2``: the windows ``at`` to ``at + n - 1`` (in words) of a text start in
    document ``first``, too, which is smaller than ``d``. ``texts`` has ``d, t, text``.

    ``first_t`` and ``first_at`` say where there, and ``s1, s2`` is the witness of the span's words as read at that place.
    Single edges, looked up by a hash of all their words, have nulls for the place and zeros for the witness.
    """
    texts = keyed(texts)
    runs = stored(live_runs(texts, word_units(width, min(CORE, width)), across=True).withColumnRenamed("first", "at"))
    paths = stored(_paths(texts, runs, width))
    discard(runs)
    spans = compact(paths)
    # the first document's own spans, and branches edge by edge
    read = stored(_read_back(texts, spans.filter("first = d"), width))
    edges = read.filter("edge").select("g1", "g2", "d", "t", "at")
    first = edges.groupBy("g1", "g2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    # stored, so that the join can be split where an edge, or a span, is frequent
    first = stored(first.filter("first < last").drop("last"))
    later = edges.join(first, ["g1", "g2"]).filter("first < d")
    place = F.min(F.struct("t", "at", "s1", "s2")).alias("place")
    sources = stored(read.filter("not edge").groupBy("g1", "g2", "n", F.col("d").alias("first")).agg(place))
    found = spans.filter("first < d").join(sources, ["g1", "g2", "n", "first"], "left")
    found = found.select(
        *["d", "t", "at", "n", "first", F.col("place.t").alias("first_t"), F.col("place.at").alias("first_at")],
        *[F.coalesce(f"place.{s}", F.lit(0).cast("long")).alias(s) for s in ("s1", "s2")],
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    return found.unionByName(
        later.select("d", "t", "at", one.alias("n"), "first", none.alias("first_t"), none.alias("first_at"), zero.alias("s1"), zero.alias("s2"))
    )


def verified(words: list[bytes], at: np.ndarray, n: np.ndarray, s: np.ndarray, width: int) -> np.ndarray:
    """Which spans of a text have the words that were read at their source; single edges, without a witness, all do."""
    inside = at + n + width - 1 <= len(words)
    ask = np.flatnonzero(inside & s.any(axis=1))
    if len(ask):
        here = _hashes(_places(words), at[ask], n[ask] + width - 1, _witness)
        inside[ask] = (here == s[ask]).all(axis=1)
    return inside


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    texts = id_and_text(docs, doc_id, text)
    parts = by_document(repeated_spans(texts, width), ["d", "t"], "at", "n", "s1", "s2")
    joined = texts.join(parts, ["d", "t"], "left").select("d", "text", "parts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            fields = [numbers(batch.column(2), f) for f in ("at", "n", "s1", "s2")]
            rows = []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                words = raw.split()
                at, n, s1, s2 = (f[i] for f in fields)
                good = verified(words, at, n, np.stack([s1, s2], axis=1), width)
                starts, ends = covered(at[good], n[good] + width - 1, len(words))
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["d", "n_words", "n_removed", "kept_sha256"])

    out = joined.mapInArrow(each, "d long, n_words long, n_removed long, kept_sha256 string")
    return out.select(public_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256")
