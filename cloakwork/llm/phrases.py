"""Phrase collocations by Toivonen's method.

A phrase is a row of words within one piece of a text; it is frequent in its language from ``least`` occurrences on, and
all parts of a frequent phrase are frequent. Two passes over the table and one over a sample find all of them:

1. The sample, a fixed share of the texts, proposes the phrases that occur in it often enough for a lowered threshold.
2. A full pass counts them and their *negative border* exactly: single words, and every phrase whose first and last
   words (all but its last, and all but its first) were proposed. Border phrases that turn out frequent are *failures*.
3. An expansion pass counts everything that failures open, at once to any length: every phrase that holds a failure and
   whose first and last words are frequent or are themselves counted here. This closes the search: take a frequent
   phrase that pass 2 did not count; the shortest part of it that was not proposed has proposed parts only, so it was
   counted, is frequent, and is a failure; and what lies between it and the phrase is counted here by the same rule. So the
   border has no further failures. The pass also counts the frequent phrases once more and spells them; its rows are the result.

Phrases travel as 128-bit hashes of their words and language. Which phrases were proposed, are frequent or have failed is
told to the tasks by bit maps of at most ``MOST_BITS`` bits, two bits for each phrase: a phrase held for proposed by
mistake is only counted needlessly, so results are exact whatever the size. Counts are summed within a task first.

Null texts are empty; a null language is ``und``. Rows count as often as they occur; ids, null or repeated, only pick the
sample, and extra columns are left behind. A text is looked at in stretches of about
``STRETCH`` bytes, so its length is no matter, but for the length of a single word. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.files import opened, written
from cloakwork.llm.texts import Powers, mixed, raw_texts, signed, small_batches
from cloakwork.plans.skew import join_hot
from cloakwork.plans.stored import stored, work_folder

STRETCH = 1 << 20
MOST_BITS = 1 << 28
#: A task sums up its phrases when it holds so many, and gives away its sums when they are so many.
HELD = 1 << 20
_PAGES = 64

# A-Z as a-z, the ends of pieces as line feeds, tabs as spaces.
_PLAIN = bytearray(range(256))
for _c in range(65, 91):
    _PLAIN[_c] += 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _PLAIN[_c] = 10
_PLAIN[9] = 32
_PLAIN = bytes(_PLAIN)
_FAMILIES = (
    (Powers(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)),
    (Powers(0xC2B2AE3D27D4EB4F), np.uint64(0x2545F4914F6CDD1D)),
)


@dataclass(frozen=True)
class Shape:
    least: int = 100
    words: int = 5
    top: int = 2000
    share: int = 8
    """One text in so many is in the sample."""
    lowered: float = 0.5
    """The sample's threshold, as a share of what a phrase just frequent is expected to have there."""


# ------------------------------------------------------------------ stretches of text


class Stretch:
    """Words of plain text: place and hashes of each, and whether the next one is of the same piece."""

    def __init__(self, data: bytes, seen: int = 0):
        """``seen``: so many words at the beginning are there for what follows them; phrases of them alone don't count."""
        self.data, self.seen = data, seen
        raw = np.frombuffer(data, np.uint8)
        gap = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        values = raw.astype(np.uint64) + np.uint64(1)
        self.hashes = [mixed(p.spans(p.prefix(values), self.starts, self.ends)) for p, _ in _FAMILIES]
        piece = np.cumsum(raw == 10)[self.starts] if len(self.starts) else self.starts
        self.linked = piece[1:] == piece[:-1]

    def keys(self, most: int, lang: tuple[np.uint64, np.uint64]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each length: whether a phrase begins at a word, and its two hashes."""
        n = len(self.starts)
        whole, sums = np.ones(n, bool), [np.zeros(n, np.uint64)] * 2
        for k in range(1, min(most, n) + 1):
            m = n - k + 1
            if k > 1:
                whole = whole[:m] & self.linked[k - 2 : k - 2 + m]
            sums = [s[:m] * base + h[k - 1 :] for s, h, (_, base) in zip(sums, self.hashes, _FAMILIES)]
            yield k, whole, [mixed(s + seed + np.uint64(k)) for s, seed in zip(sums, lang)]

    def counted(self, k: int, here: np.ndarray) -> np.ndarray:
        """Places among ``here`` whose phrase is not of seen words alone."""
        at = np.flatnonzero(here)
        return at[at + k > self.seen] if self.seen else at

    def phrase(self, i: int, k: int) -> bytes:
        return b" ".join([self.data[a:b] for a, b in zip(self.starts[i : i + k].tolist(), self.ends[i : i + k].tolist())])


def stretches(texts: list[bytes], most: int) -> Iterator[Stretch]:
    """Texts one after the other as stretches of about ``STRETCH`` bytes; a longer text gives several."""
    held, size = [], 0
    for raw in texts:
        raw = raw.translate(_PLAIN)
        if len(raw) <= STRETCH:
            held.append(raw)
            size += len(raw)
            if size >= STRETCH:
                yield Stretch(b"\n".join(held))
                held, size = [], 0
            continue
        at, before, seen = 0, b"", 0
        while at < len(raw):
            stop = min(len(raw), at + STRETCH)
            while stop < len(raw) and raw[stop] not in (10, 32):
                ends = [x for x in (raw.find(b" ", stop), raw.find(b"\n", stop)) if x >= 0]
                stop = min(ends, default=len(raw))
            out = Stretch(before + raw[at:stop], seen)
            yield out
            at = stop
            seen = min(most - 1, len(out.starts))
            # the last words, for phrases that reach into what follows
            before = out.data[out.starts[-seen] :] if seen else b"\n"
    if held:
        yield Stretch(b"\n".join(held))


def _seeds(lang: str) -> tuple[np.uint64, np.uint64]:
    raw = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.array([0]), np.array([len(raw)])
    return tuple(mixed(p.spans(p.prefix(raw), *ends) + np.uint64(7))[0] for p, _ in _FAMILIES)


def by_language(batch: pa.RecordBatch, most: int) -> Iterator[tuple[str, tuple, Stretch]]:
    langs = batch.column(0).to_pylist()
    groups: dict[str, list[bytes]] = {}
    for lang, raw in zip(langs, raw_texts(batch.column(1))):
        groups.setdefault(lang, []).append(raw)
    for lang, texts in groups.items():
        seeds = _seeds(lang)
        for stretch in stretches(texts, most):
            yield lang, seeds, stretch


# ------------------------------------------------------------------ counting


class Tally:
    """Counts of phrases by language and length, summed up as they come."""

    def __init__(self):
        self.new: dict[tuple[str, int], list] = {}
        self.sums: dict[tuple[str, int], list] = {}
        self.n_new = self.n_sums = 0

    def add(self, lang: str, k: int, one: np.ndarray, two: np.ndarray) -> None:
        self.new.setdefault((lang, k), []).append((one, two, np.ones(len(one), np.int64)))
        self.n_new += len(one)

    def settle(self) -> None:
        """Sum up what is new. Rows of one phrase may stay apart if the first hashes of two phrases are the same."""
        for key, parts in self.new.items():
            one, two, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(one)
            one, two, n = one[order], two[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)])
            self.sums.setdefault(key, []).append((one[first], two[first], np.add.reduceat(n, first) if len(first) else n))
            self.n_sums += len(first)
        self.new, self.n_new = {}, 0

    def given(self) -> Iterator[pa.RecordBatch]:
        for key, parts in self.sums.items():  # sums of several rounds once more together
            self.new[key] = parts
        self.sums, self.n_sums = {}, 0
        self.settle()
        for (lang, k), ((one, two, n),) in self.sums.items():
            for low in range(0, len(n), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield _rows(lang, k, one[part], two[part], n[part])
        self.sums, self.n_sums = {}, 0

    def due(self) -> Iterator[pa.RecordBatch]:
        if self.n_new >= HELD:
            self.settle()
        if self.n_sums >= HELD:
            yield from self.given()


_COLUMNS = "lang string, k int, h1 long, h2 long, n long, phrase string"
_KEY = ["lang", "k", "h1", "h2"]


def _rows(lang: str, k: int, one: np.ndarray, two: np.ndarray, n: np.ndarray, spelled: list[bytes] | None = None) -> pa.RecordBatch:
    m = len(one)
    words = pa.array(spelled, pa.binary()).cast(pa.string()) if spelled is not None else pa.nulls(m, pa.string())
    columns = [pa.array([lang] * m, pa.string()), pa.array(np.full(m, k, np.int32)), pa.array(signed(one)), pa.array(signed(two)), pa.array(n), words]
    return pa.RecordBatch.from_arrays(columns, ["lang", "k", "h1", "h2", "n", "phrase"])


# ------------------------------------------------------------------ bit maps


class BitMap:
    """Phrases told by two bits each: none that was put in is denied."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.page = len(bits) * 8 // _PAGES

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        base = (one >> np.uint64(58)) * np.uint64(self.page)
        out = np.ones(len(one), bool)
        for shift in (0, 32):
            at = base + ((two >> np.uint64(shift)) & np.uint64(self.page - 1))
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


def bit_map(phrases: DataFrame, folder: str, name: str) -> str:
    """Write a map of the phrases ``h1, h2``, of 16 bits for each and ``MOST_BITS`` at most; its address."""
    n = phrases.count()
    page = min(max(1 << 14, 1 << max(0, (16 * n // _PAGES) - 1).bit_length()), MOST_BITS // _PAGES)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            one, two = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            own = (one >> np.uint64(58)).astype(np.int64)
            for p in np.unique(own).tolist():
                bits = found.setdefault(p, np.zeros(page, bool))
                mine = two[own == p]
                for shift in (0, 32):
                    bits[((mine >> np.uint64(shift)) & np.uint64(page - 1)).astype(np.int64)] = True
        for p, bits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["page", "bits"])

    dealt = phrases.select("h1", "h2").repartitionById(_PAGES // 4, F.shiftrightunsigned("h1", 60).cast("int"))
    bits = np.zeros((_PAGES, page // 8), np.uint8)
    for row in dealt.mapInArrow(pages, "page long, bits binary").collect():  # a row for each page, MOST_BITS in all
        bits[row["page"]] |= np.frombuffer(row["bits"], np.uint8)
    uri = f"{folder}/{name}.bits"
    with written(uri) as out:
        out.write(bits.tobytes())
    return uri


@lru_cache(maxsize=3)
def loaded(uri: str) -> BitMap:
    with opened(uri) as file:
        return BitMap(np.frombuffer(file.read(), np.uint8))


# ------------------------------------------------------------------ passes


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Language and text, nulls filled in."""
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"))


def sample_counts(texts: DataFrame, most: int) -> DataFrame:
    """Every phrase of some texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for lang, seeds, stretch in by_language(batch, most):
                for k, whole, (one, two) in stretch.keys(most, seeds):
                    at = stretch.counted(k, whole)
                    tally.add(lang, k, one[at], two[at])
                yield from tally.due()
        tally.settle()
        yield from tally.given()

    return _summed(texts.mapInArrow(count, _COLUMNS))


def border_counts(texts: DataFrame, most: int, proposed: str) -> DataFrame:
    """Words, and phrases whose first and last words are proposed: the proposed phrases and their negative border."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, known = Tally(), loaded(proposed)
        for batch in batches:
            for lang, seeds, stretch in by_language(batch, most):
                held = None  # where a proposed phrase of one word less begins
                for k, whole, (one, two) in stretch.keys(most, seeds):
                    here = whole if held is None else whole & held[:-1] & held[1:]
                    at = stretch.counted(k, here)
                    tally.add(lang, k, one[at], two[at])
                    every = np.flatnonzero(here)
                    held = np.zeros(len(here), bool)
                    held[every] = known.has(one[every], two[every])
                yield from tally.due()
        tally.settle()
        yield from tally.given()

    return _summed(texts.mapInArrow(count, _COLUMNS))


def expansion_counts(texts: DataFrame, most: int, frequent: str, failures: str) -> DataFrame:
    """Frequent phrases, and phrases that failures open; each spelled at least once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, known, failed = Tally(), loaded(frequent), loaded(failures)
        spelled: set[int] = set()
        for batch in batches:
            for lang, seeds, stretch in by_language(batch, most):
                held = opened_up = None  # where a phrase of one word less is known or counted; where it holds a failure
                for k, whole, (one, two) in stretch.keys(most, seeds):
                    here = whole if held is None else whole & held[:-1] & held[1:]
                    above = np.zeros(len(here), bool) if opened_up is None else opened_up[:-1] | opened_up[1:]
                    every = np.flatnonzero(here)
                    is_known, own_failure = known.has(one[every], two[every]), failed.has(one[every], two[every])
                    held = np.zeros(len(here), bool)
                    held[every] = is_known | above[every]
                    opened_up = above
                    opened_up[every] |= own_failure
                    at = stretch.counted(k, held)
                    tally.add(lang, k, one[at], two[at])
                    firsts, places = np.unique(one[at], return_index=True)
                    fresh = [i for i, h in enumerate(firsts.tolist()) if h not in spelled]
                    if fresh:
                        spelled.update(firsts[fresh].tolist())
                        own = at[places[fresh]]
                        yield _rows(lang, k, one[own], two[own], np.zeros(len(own), np.int64), [stretch.phrase(i, k) for i in own.tolist()])
                if len(spelled) > 1 << 20:
                    spelled.clear()
                yield from tally.due()
        tally.settle()
        yield from tally.given()

    return texts.mapInArrow(count, _COLUMNS)


def frequent_phrases(docs: DataFrame, shape: Shape = Shape(), doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, n`` of all phrases that occur ``least`` times or more in a language, and ``lang, n``: its words."""
    small_batches(docs)
    folder, most = work_folder(docs.sparkSession), shape.words
    texts = _texts(docs, lang, text)
    sampled = docs.filter(F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(f"`{text}`")), F.lit(shape.share)) == 0)
    lowered = max(2, round(shape.lowered * shape.least / shape.share))
    proposed = stored(sample_counts(_texts(sampled, lang, text), most).filter(F.col("n") >= lowered).select("h1", "h2"))
    told = bit_map(proposed, folder, "proposed")
    counted = border_counts(texts, most, told)
    # all words are counted, rare ones for the sum only
    counted = stored(counted.filter((F.col("k") == 1) | (F.col("n") >= shape.least)))
    totals = counted.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counted.filter(F.col("n") >= shape.least).select("h1", "h2")
    failures = stored(join_hot(frequent, proposed, ["h1", "h2"], "left_anti"))
    rows = expansion_counts(texts, most, bit_map(frequent, folder, "frequent"), bit_map(failures, folder, "failures"))
    found = rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("phrase").alias("phrase")).filter(F.col("n") >= shape.least)
    return stored(found.select("lang", "k", "phrase", "n")), stored(totals)


# ------------------------------------------------------------------ scores


def scored(found: DataFrame, totals: DataFrame, least_words: int = 2) -> DataFrame:
    """``lang, phrase, k, a, l, r, n, score`` of the phrases of ``least_words`` or more, at their lowest-scoring cut.

    Products are taken as decimals of 38 digits.
    """
    words = F.split("phrase", " ")
    long = found.filter(F.col("k") >= least_words).select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"))
    cuts = long.select("lang", "phrase", "k", "a", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "k", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("first"), F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ").alias("rest")
    )
    for part, out in (("first", "l"), ("rest", "r")):
        cuts = join_hot(cuts, found.select("lang", F.col("phrase").alias(part), F.col("n").alias(out)), ["lang", part])
    cuts = join_hot(cuts, totals.select("lang", "n"), ["lang"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = F.expr("cast(1000 * cast(_a as decimal(38,0)) * _n div (cast(_l as decimal(38,0)) * _r) as bigint)")
    cuts = cuts.withColumns({f"_{c}": v for c, v in wide.items()}).withColumn("score", score)
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "k", "a", "n").agg(best).select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def not_inside_longer(rows: DataFrame) -> DataFrame:
    """Phrases that lie in no longer one that occurs as often. If one does, so does one that is longer by a single word."""
    long = rows.filter("k > 2").select("lang", "phrase", "a", "k", F.split("phrase", " ").alias("w"))
    parts = [F.array_join(F.expr(f"slice(w, {low}, k - 1)"), " ") for low in (1, 2)]
    inside = long.select("lang", "a", F.explode(F.array(*parts)).alias("phrase"))
    return join_hot(rows, inside, ["lang", "phrase", "a"], "left_anti")


def best(rows: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each language, numbered. They are picked within parts of a language first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= top).drop("_part")


def report(docs: DataFrame, shape: Shape = Shape(), doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two words or more."""
    found, totals = frequent_phrases(docs, shape, doc_id, lang, text)
    rows = stored(scored(found, totals))
    return best(not_inside_longer(rows), shape.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
