"""Repeated windows without a row per window.

Every window of ``width`` units (bytes or words) holds a least ``core``: the leftmost of its shorter windows of ``core``
units with the least hash. Neighbouring windows mostly share it, so a text falls into *runs*: maximal rows of windows
with one least core. Equal windows have equal least cores at equal places, so windows need comparing only with those of
runs with the same core. A core that occurs once ends the matter for its whole run; most do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.texts import BYTES, mixed, raw_texts, signed, word_hashes

#: Windows of a text are cut into runs in stretches of so many.
STRETCH = 1 << 20
#: A core that would fill more than about this many rows is dealt out over several tasks.
CROWD = 20_000
SAMPLED = 64
#: No more crowded cores than this are looked after.
MOST_CROWDED = 4096


@dataclass(frozen=True)
class Units:
    """What texts are made of, how wide windows are, and how wide the cores that sort them."""

    width: int
    core: int
    cores: Callable[[bytes], np.ndarray]
    """A well mixed hash of each stretch of ``core`` units of a text."""

    def runs(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """Core, first window, number of windows, and how far the core lies behind the first window's start, of each run."""
        return runs(self.cores(raw), self.width - self.core + 1)


def byte_units(width: int, core: int) -> Units:
    def cores(raw: bytes) -> np.ndarray:
        if len(raw) < width:
            return np.zeros(0, np.uint64)
        data, out = np.frombuffer(raw, np.uint8), []
        for at in range(0, len(data) - core + 1, STRETCH):
            part = data[at : at + STRETCH + core - 1]
            starts = np.arange(len(part) - core + 1)
            prefix = BYTES.prefix(part.astype(np.uint64) + np.uint64(1))
            out.append(mixed((prefix[core:] - prefix[:-core]) * BYTES.down[: len(starts)]))
        return out[0] if len(out) == 1 else np.concatenate(out)

    return Units(width, core, cores)


def word_units(width: int, core: int) -> Units:
    def cores(raw: bytes) -> np.ndarray:
        words = word_hashes(raw)[2]
        n = len(words) - core + 1
        if len(words) < width:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(core):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
        return mixed(h)

    return Units(width, core, cores)


def runs(cores: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Windows of ``span`` cores each, cut into runs with the same least core."""
    n = len(cores) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    low = np.uint64(STRETCH * 2 - 1)  # the place takes the hash's low bits: of equal ones the leftmost is least
    found, firsts, counts, leads = [], [], [], []
    for at in range(0, n, STRETCH):
        part = cores[at : at + STRETCH + span - 1]
        m = len(part) - span + 1
        least, reach = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * reach <= span:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        least = np.minimum(least[:m], least[span - reach : span - reach + m])
        place = (least & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        found.append(part[place[first]])
        firsts.append(first + at)
        counts.append(np.diff(np.concatenate([first, [m]])))
        leads.append(place[first] - first)
    return tuple(map(np.concatenate, (found, firsts, counts, leads)))


def keyed(texts: DataFrame) -> DataFrame:
    """``texts(d, t, ...)`` with ``k``, one long for a row's id and text.

    Runs carry it in place of the id, so that rows which share an id, null above all, do not share their runs. Where two
    rows have one ``k`` by chance, each is given the runs of both, and leaves out what its own text does not have.
    """
    return texts.withColumn("k", F.xxhash64("d", "t"))


def run_rows(texts: DataFrame, units: Units, crowded: dict[int, int] | None = None) -> DataFrame:
    """``core, k, first, n, lead, slice`` of every run of ``texts(k, text)``.

    ``slice`` is 0 but for the ``crowded`` cores, whose runs are dealt out over so many slices, numbered from 1.
    """
    cores = np.array(sorted(crowded or {}), np.int64)
    slices = np.array([crowded[c] for c in cores.tolist()], np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            held: list[tuple] = []
            rows = 0
            for k, raw in zip(ids, raw_texts(batch.column(1))):
                core, first, n, lead = units.runs(raw)
                if len(core):
                    held.append((signed(core), np.full(len(core), k), first, n.astype(np.int16), lead.astype(np.int16)))
                    rows += len(core)
                if rows > 500_000:
                    yield packed(held)
                    held, rows = [], 0
            if held:
                yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        core, k, first, *rest = (np.concatenate(c) for c in zip(*held))
        slice_ = np.zeros(len(core), np.int32)
        if len(cores):
            at = np.minimum(np.searchsorted(cores, core), len(cores) - 1)
            hit = np.flatnonzero(cores[at] == core)
            dealt = mixed(k[hit].view(np.uint64) * np.uint64(31) + first[hit].astype(np.uint64)) % slices[at[hit]].astype(np.uint64)
            slice_[hit] = dealt.astype(np.int32) + 1
        columns = [pa.array(c) for c in (core, k, first, *rest, slice_)]
        return pa.RecordBatch.from_arrays(columns, ["core", "k", "first", "n", "lead", "slice"])

    return texts.select("k", "text").mapInArrow(each, "core long, k long, first long, n short, lead short, slice int")


def crowded_cores(texts: DataFrame, units: Units, across: bool) -> dict[int, int]:
    """The cores that look most crowded in a sample, with the number of slices for each.

    They decide how the work is laid out and not its result, so the list is of bounded length. They occur again
    for certain: the sample has seen them do so.
    """
    some = run_rows(texts.filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(SAMPLED)) == 0), units)
    counted = some.groupBy("core").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
    many = counted.filter((F.col("rows") * SAMPLED > CROWD) & (F.col("low") < F.col("high") if across else F.col("rows") > 1))
    most = many.orderBy(F.col("rows").desc(), "core").limit(MOST_CROWDED).collect()
    return {r["core"]: -(-r["rows"] * SAMPLED // CROWD) for r in most}


def live_runs(texts: DataFrame, units: Units, across: bool) -> DataFrame:
    """The runs of ``keyed`` texts whose core occurs again: in another row (``across``; not in repeats of one), or anywhere.

    One shuffle by core. The cores that are crowded are dealt out by document as well.
    """
    rows = run_rows(texts, units, crowded_cores(texts, units, across))
    group = Window.partitionBy("core", "slice")
    again = F.min("k").over(group) < F.max("k").over(group) if across else F.count(F.lit(1)).over(group) > 1
    kept = rows.withColumn("again", again).filter(F.col("again") | (F.col("slice") > 0))
    return kept.select("core", "k", "first", "n", "lead")


def by_document(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows as one array ``parts`` per document, each once: no more than its own text gives rise to, however often it is repeated."""
    return rows.groupBy(*keys).agg(F.collect_set(F.struct(*columns)).alias("parts"))


def numbers(parts: pa.Array, field: str) -> list[np.ndarray]:
    """A field of an array of structs, as one NumPy array per row; null as empty."""
    parts = parts.fill_null([]) if parts.null_count else parts
    at = parts.offsets.to_numpy()
    flat = parts.values.field(field).to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def covered(at: np.ndarray, size: np.ndarray | int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered stretches of ``length`` units."""
    size = np.broadcast_to(size, at.shape)
    inside = (at >= 0) & (at + size <= length)
    at, size = at[inside], size[inside]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    at, ends = at[order], np.maximum.accumulate((at + size)[order])
    new = np.concatenate([[True], at[1:] > ends[:-1]])
    return at[new], np.concatenate([ends[:-1][new[1:]], ends[-1:]])
