"""Repeated byte strings by hashes of suffixes, refined as in a depth-limited radix sort.

No suffix is ordered: suffixes are grouped by the hashes of pieces of their first ``DEPTH`` bytes; groups still equal after the
last piece, called a digit here, are exactly the repeated strings of that length, and groups of one leave after any digit. The digits are not
read from left to right, so that whole runs of suffixes can be judged as one row as long as they stay together:

1. the least core of 32 bytes within those bytes (see ``runs``): the suffixes of a run share it;
2. the whole content of the run: runs equal in it are equal suffix by suffix, so all but the first are done;
3. for the first of the runs that share a core but not their content: stretches of 8 suffixes, cut at the same distances
   from the core, first by the bytes that all 8 have in common and then, like runs, by their whole content;
4. for the first of the stretches that share the common bytes but not their content: each suffix's own ``DEPTH`` bytes.

Digits are 128-bit hashes of the bytes themselves. Of equal suffixes the first in the least document stays, which
takes a flag within the document and a partial aggregation of ids across documents.

Null and short texts have no string of that length, so nothing is removed. Null ids sort before all others and stay
null. Rows that share an id remove nothing from each other, so repeated rows fare alike. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.runs import by_document, byte_units, covered, keyed, live_runs, numbers
from cloakwork.llm.texts import id_and_keys, id_and_text, public_id, raw_texts
from cloakwork.plans.stored import discard, stored

DEPTH = 100
CORE = 32
#: Suffixes in a stretch of the third digit.
STRIDE = 8
_KEY = "g1 long, g2 long, core long, d long, t long, at long, n int, lead int, again boolean"
_Items = tuple[list[bytes], dict[str, np.ndarray]]


def _runs_whole(raw: bytes, run: dict[str, np.ndarray], depth: int) -> _Items:
    ends = run["at"] + run["n"] + depth - 1
    return [raw[a:b] for a, b in zip(run["at"].tolist(), ends.tolist())], run


def _stretches(raw: bytes, run: dict[str, np.ndarray], depth: int) -> _Items:
    """Suffixes at distances ``stride * k`` to ``stride * (k + 1) - 1`` before the core. What they share takes the core's place."""
    stride = max(1, min(STRIDE, depth // 4))
    far, near = run["lead"], run["lead"] - run["n"] + 1
    pieces = far // stride - near // stride + 1
    of = np.repeat(np.arange(len(pieces)), pieces)
    k = near[of] // stride + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    high, low = np.minimum(far[of], k * stride + stride - 1), np.maximum(near[of], k * stride)
    core_at = (run["at"] + far)[of]
    at, n, common = core_at - high, high - low + 1, (core_at - k * stride).tolist()
    own = [xxhash.xxh3_64_intdigest(raw[a : a + depth - stride + 1], i) for i, a in zip(k.tolist(), common)]
    texts = [b"%d %d " % (i, j) + raw[a : a + c] for i, j, a, c in zip(k.tolist(), high.tolist(), at.tolist(), (n + depth - 1).tolist())]
    return texts, {"core": np.array(own, np.uint64).view(np.int64), "at": at, "n": n, "lead": high}


def _single(raw: bytes, run: dict[str, np.ndarray], depth: int) -> _Items:
    n = run["n"]
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at, unique = np.unique(run["at"][of] + step, return_index=True)
    of, step = of[unique], step[unique]
    one = {"core": run["core"][of], "at": at, "n": np.ones(len(at), np.int64), "lead": run["lead"][of] - step}
    return [raw[a : a + depth] for a in at.tolist()], one


def _digits(texts: DataFrame, rows: DataFrame, keys: list[str], cut: Callable[..., _Items], depth: int) -> DataFrame:
    """The next digit, ``g1, g2``, of the listed runs as cut up by ``cut``; ``again``: it was there before in its text."""
    parts = by_document(rows, keys, "core", "at", "n", "lead")
    joined = texts.join(parts, keys).select("d", "t", "text", "parts")
    names = [c.split()[0] for c in _KEY.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            held: list[tuple] = []
            fields = {f: numbers(batch.column(3), f) for f in ("core", "at", "n", "lead")}
            ids, ts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            waiting = 0
            for i, raw in enumerate(raw_texts(batch.column(2))):
                run = {f: v[i].astype(np.int64) for f, v in fields.items()}
                # in order, each once
                order = np.unique(run["at"] * (depth + 1) + run["n"], return_index=True)[1]
                # those of another row with this key may reach beyond this text
                order = order[run["at"][order] + run["n"][order] + depth - 1 <= len(raw)]
                strings, item = cut(raw, {f: v[order] for f, v in run.items()}, depth)
                if not strings:
                    continue
                g = np.frombuffer(b"".join(map(digest, strings)), "<i8").reshape(-1, 2)
                by = np.lexsort((item["at"], g[:, 1], g[:, 0]))
                again = np.zeros(len(g), bool)
                again[by[1:]] = (g[by[1:]] == g[by[:-1]]).all(axis=1)
                own = (g[:, 0], g[:, 1], item["core"], np.full(len(g), ids[i]), np.full(len(g), ts[i]), item["at"])
                held.append((*own, item["n"].astype(np.int32), item["lead"].astype(np.int32), again))
                waiting += len(g)
                if waiting > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                    held, waiting = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return joined.mapInArrow(each, _KEY)


def _shared(digits: DataFrame) -> DataFrame:
    """Digits that several documents have, with the least of them. Stored, so that a join with it can be split where a
    digit is frequent: a join shares no shuffle with an aggregation then."""
    ids = digits.filter("not again").groupBy("g1", "g2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    return stored(ids.filter("first < last").drop("last"))


def _earlier(digits: DataFrame, shared: DataFrame) -> DataFrame:
    """``again`` also where a smaller document has the digit."""
    joined = digits.join(shared, ["g1", "g2"], "left")
    return joined.withColumn("again", F.col("again") | F.coalesce(F.col("first") < F.col("d"), F.lit(False)))


def _sorted(digits: DataFrame) -> DataFrame:
    """Rows that were there before (``again``), and the first of those that share a core but not their content."""
    forks = digits.groupBy("core").agg(F.min("g1").alias("low"), F.max("g1").alias("high")).filter("low < high")
    forks = stored(forks.select("core", F.lit(True).alias("fork")))
    shared = _shared(digits)
    judged = _earlier(digits, shared).select("core", "d", "t", "at", "n", "lead", "again").join(forks, "core", "left")
    out = stored(judged.filter("again or fork").drop("fork"))
    discard(digits, shared, forks)
    return out


def repeats(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``d, t, at, n``: the suffixes ``at`` to ``at + n - 1`` of a text begin with ``depth`` bytes that also begin at
    an earlier place. ``texts`` has ``d, t, text``."""
    item = ["d", "t", "at", "n"]
    texts = keyed(texts)
    runs = stored(live_runs(texts, byte_units(depth, min(CORE, depth)), across=False).withColumnRenamed("first", "at"))
    whole = stored(_digits(texts, runs, ["k"], _runs_whole, depth))
    discard(runs)
    whole = _sorted(whole)
    parts = _sorted(stored(_digits(texts, whole.filter("not again"), ["d", "t"], _stretches, depth)))
    single = stored(_digits(texts, parts.filter("not again"), ["d", "t"], _single, depth).select("g1", "g2", *item, "again"))
    later = _earlier(single, _shared(single)).filter("again")
    done = whole.filter("again").select(*item).unionByName(parts.filter("again").select(*item))
    return done.unionByName(later.select(*item))


def _with_repeats(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts(d, t, ...)`` with ``parts``, the array of repeats or null."""
    return texts.join(by_document(found, ["d", "t"], "at", "n"), ["d", "t"], "left")


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    texts = id_and_text(docs, doc_id, text)
    joined = _with_repeats(texts, repeats(texts, depth)).select("d", "text", "parts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = numbers(batch.column(2), "at"), numbers(batch.column(2), "n")
            rows = []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                starts, ends = covered(at[i], n[i] + depth - 1, len(raw))
                kept = _kept(raw, starts, ends)
                rows.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.mapInArrow(each, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(public_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def whole_characters(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches without the characters that they cut in two."""
    inside = (np.frombuffer(raw + b"\0", np.uint8) & 0xC0) == 0x80  # not the first byte of its character
    place = np.arange(len(raw) + 1)
    before = np.maximum.accumulate(np.where(inside, 0, place))
    after = np.minimum.accumulate(np.where(inside, len(raw), place)[::-1])[::-1]
    starts, ends = after[starts], before[ends]
    return starts[starts < ends], ends[starts < ends]


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", depth: int = DEPTH) -> DataFrame:
    """``docs`` without the repeated strings, all columns and rows kept; ``length``, if there, is set to the new length.

    A character cut in two by a removed stretch stays whole. A null text stays null.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for given, a, k in zip(texts, at, n):
            if given is not None and a is not None and len(a):
                raw = given.encode()
                stretches = covered(np.asarray(a), np.asarray(k) + depth - 1, len(raw))
                given = _kept(raw, *whole_characters(raw, *stretches)).decode()
            out.append(given)
        return pd.Series(out, dtype=object)

    texts = id_and_text(docs, doc_id, text)
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()])
    keyed = given.select("*", *id_and_keys(inner[doc_id], inner[text]))
    joined = _with_repeats(keyed, repeats(texts, depth))
    new = joined.withColumn(inner[text], cut(inner[text], F.col("parts.at"), F.col("parts.n")))
    if length in inner:
        new = new.withColumn(inner[length], F.length(inner[text]).cast(docs.schema[length].dataType))
    return new.select(*[F.col(i).alias(c) for c, i in inner.items()])
