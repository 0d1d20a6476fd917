"""Document fingerprints by consistent weighted sampling.

A text is its shingles of five words, each weighing as often as it occurs (fewer words: one shingle of all). For each of
``SAMPLES`` samples a term of weight ``w`` draws ``r`` and ``c`` from Gamma(2, 1) and ``b`` from (0, 1), always the same
for the same term, and has ``t = floor(ln w / r + b)``, ``ln y = r (t - b)`` and ``ln a = ln c - ln y - r``. The sample is the term with the least ``a``,
with its ``t``. Two texts agree in a sample with a probability equal to their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones. A fingerprint keeps 16 bits of each sample.

The draws come from tables, of which a term's hash picks one row for ``r`` and ``b`` and another for ``c``.

A text is handled in its id's range: texts are dealt out by id and sorted, so each one's successor is the next row, and
only the first text of a range is sent twice, to the range before it.

Null texts are empty. Texts without words have a fingerprint of zeros, like each other fully and no other text at all.
Null ids come first; rows with one id follow each other by their texts' hashes. One row is its own successor; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.files import id_bounds, range_of, width
from cloakwork.llm.texts import id_and_keys, id_and_text, mixed, public_id, raw_texts, word_hashes

SAMPLES = 128
SHINGLE = 5
_ROWS = 1 << 14
_PART = 256


class Draws:
    """The tables of draws, the same in every process. A term's draws for all samples lie in one row."""

    def __init__(self, samples: int = SAMPLES, seed: int = 20):
        rnd = np.random.Generator(np.random.PCG64(seed))
        shape = (samples, _ROWS)

        def by_term(table: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(table.T)

        self.r = by_term(rnd.gamma(2.0, 1.0, shape).astype(np.float32))
        self.b = by_term(rnd.random(shape, np.float32))
        self.log_c = by_term(np.log(rnd.gamma(2.0, 1.0, shape)).astype(np.float32))
        self.once = self.r * self.b - self.r  # ln a less ln c at weight 1, where t is 0
        self.numbers = mixed(np.arange(1, samples + 1, dtype=np.uint64))

    def sample(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The samples' 16 bits, for terms as distinct sorted hashes."""
        samples = len(self.numbers)
        best, place = np.full(samples, np.inf, np.float32), np.zeros(samples, np.int64)
        each = np.arange(samples)
        one, two = (terms & np.uint64(_ROWS - 1)).astype(np.int64), (terms >> np.uint64(50)).astype(np.int64)
        heavy = weights > 1
        any_heavy = heavy.any()
        for low in range(0, len(terms), _PART):
            rows = one[low : low + _PART]
            a = self.once[rows]
            more = np.flatnonzero(heavy[low : low + _PART]) if any_heavy else ()
            if len(more):
                r, b = self.r[rows[more]], self.b[rows[more]]
                t = np.floor(np.log(weights[low + more]).astype(np.float32)[:, None] / r + b)
                a[more] = r * b - r - r * t
            a += self.log_c[two[low : low + _PART]]
            at = a.argmin(axis=0)
            least = a[at, each]
            new = least < best
            best[new], place[new] = least[new], low + at[new]
        turn = np.zeros(samples, np.int64)
        if any_heavy:
            own = np.flatnonzero(heavy[place])
            rows, w = one[place[own]], weights[place[own]]
            turn[own] = np.floor(np.log(w).astype(np.float32) / self.r[rows, own] + self.b[rows, own])
        return (mixed(terms[place] ^ mixed(turn.view(np.uint64) + self.numbers)) >> np.uint64(48)).astype(np.uint16)


_draws: dict[int, Draws] = {}


def draws(samples: int = SAMPLES) -> Draws:
    """This process's tables."""
    if samples not in _draws:
        _draws[samples] = Draws(samples)
    return _draws[samples]


def terms(raw: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's shingles, and how often each occurs."""
    words = word_hashes(raw)[2]
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return np.unique(mixed(h + np.uint64(min(shingle, len(words)))), return_counts=True)


def fingerprint(raw: bytes, samples: int = SAMPLES) -> np.ndarray | None:
    """A text's samples; None without words."""
    own, weights = terms(raw)
    return draws(samples).sample(own, weights) if len(own) else None


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of samples in which two fingerprints agree."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.count_nonzero(a == b)) / len(a)


def shown(samples: np.ndarray | None, n: int = SAMPLES) -> str:
    """A fingerprint as hexadecimal digits, four for each sample."""
    return "0" * (4 * n) if samples is None else samples.astype(">u2").tobytes().hex()


def with_successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``part, guest, d, t, text``: texts dealt out by id; a range's last row is a guest, the first row of the next range."""
    n = width(docs)
    bounds = id_bounds(docs, n, doc_id, text)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0).to_numpy(), bounds)), *batch.columns], ["part", *batch.schema.names])

    keys = docs.select(*id_and_keys(doc_id, text)).mapInArrow(deal, "part int, d long, t long")
    # a row for each range
    first = keys.groupBy("part").agg(F.min(F.struct("d", "t")).alias("k")).orderBy("part").collect()
    before = {r.part: first[i - 1].part for i, r in enumerate(first)}
    places = {(r.k.d, r.k.t): before[r.part] for r in first}

    def with_guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "guest", "d", "t", "text"]
        for batch in batches:
            part = range_of(batch.column(0).to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool)), *batch.columns], names)
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, key in enumerate(own):
                if key in places:
                    guest = [pa.array([places[key]], pa.int32()), pa.array([True]), *batch.slice(i, 1).columns]
                    yield pa.RecordBatch.from_arrays(guest, names)

    texts = id_and_text(docs, doc_id, text)
    return texts.mapInArrow(with_guests, "part int, guest boolean, d long, t long, text string"), n


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    rows, n = with_successors(docs, doc_id, text)
    ordered = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "d", "t")
    names = ["d", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the text whose successor comes next
        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)))
            for (part, guest, d), raw in zip(keys, raw_texts(batch.column(4))):
                own = fingerprint(raw)
                here = raw.decode()
                if held is not None and held[0] == part:
                    new = edited(held[2], here).encode()
                    print_ = fingerprint(new)
                    sha = hashlib.sha256(new).hexdigest()
                    near = likeness(held[3], print_), likeness(held[3], own)
                    out.append((held[1], len(held[2]), sha, shown(held[3]), shown(print_), *near))
                # further guests are the same row again
                held = None if guest else (part, d, here, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "d long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(each, schema).select(public_id().alias("doc_id"), *names[1:])
