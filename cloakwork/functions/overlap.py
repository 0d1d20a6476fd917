"""Choosing among overlapping spans, per text, over Arrow batches of span arrays inside Spark's tasks.

``compat``: walk the spans in order of (start, end, rank). A span that begins inside the last kept one
is passed over. Otherwise, of all spans that overlap it, the one with the highest score is kept, the
first in order if several tie. Spans passed over earlier may still win here, so two kept spans can
overlap; ``emit`` order (the order of the result) is then significant.

Only spans that reach beyond the last kept end can still win, so the walk carries just those: at most
a few per rule (matches of one rule do not overlap) plus external ones, however long the text is. The walk is
made island by island, so its cost follows the number of spans and not its square.

``longest``: start ascending, length descending, no overlaps among the kept spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("compat", "longest")

# Spans are walked in slices of about so many, or by one text where it has more.
SLICE = 1 << 18


def _island_finder() -> Callable:
    """Made here and not at the top, so that it travels with a task and workers need not import this package."""

    def begins(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all spans of the arrays: start, end, where each array begins (and the last one ends), which spans begin an island."""
        edges = np.concatenate([[0], np.cumsum(np.asarray(spans.value_lengths().fill_null(0)), dtype=np.int64)])
        flat = spans.flatten()  # leaves out what lies under null arrays
        # an end that is missing lies before everything
        start, end = (np.asarray(flat.field(c).fill_null(-1)).astype(np.int64) for c in ("start", "end"))
        first = np.zeros(len(start), bool)
        first[edges[:-1][np.diff(edges) > 0]] = True
        row = np.cumsum(first) << 33
        reach = np.maximum.accumulate(row + end)
        # a span that begins an array is behind all that reaches of earlier arrays
        first[1:] |= (row + start)[1:] >= np.maximum(reach[:-1], row[1:] - 1)
        return start, end, edges, first

    return begins


def island_numbers(sorted_spans: Column) -> Column:
    """``array<int>``: for each span of a sorted array the number of its island, from 0."""
    begins = _island_finder()

    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for spans in batches:
            _, _, edges, first = begins(spans)
            count = np.concatenate([[0], np.cumsum(first)])
            within = count[1:] - 1 - np.repeat(count[edges[:-1]], np.diff(edges))
            yield pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(within.astype(np.int32)))

    numbers.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(numbers, "array<int>")(sorted_spans)


def chooser(mode: str = "compat") -> Callable:
    """Made here and not at the top, like the functions above."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    begins = _island_finder()

    def walk(first: int, last: int, start: list, end: list, seq: list, score: list) -> list[int]:
        """Kept spans of one island."""
        kept, skip = [], -1
        if mode == "longest":
            for i in sorted(range(first, last), key=lambda i: (start[i], -end[i], seq[i])):
                if start[i] >= skip:
                    skip = end[i]
                    kept.append(i)
            return kept
        # What wins overlaps x and so ends beyond the last kept span: it cannot have been kept before.
        mixed, pend = len(set(score[first:last]) - {-math.inf}) > 1, []
        for i in range(first, last):
            begin = start[i]
            if begin < skip:
                if end[i] > skip:
                    pend.append(i)
                continue
            pend = [e for e in pend if end[e] > begin]
            pend.append(i)
            best = pend[0]
            # With one score for all, the first overlapping span wins and later ones cannot. Only where scores
            # differ can a span that begins later win, by a higher score.
            if mixed:
                pool = list(pend)
                for e in range(i + 1, last):
                    if start[e] >= end[i]:
                        break
                    if (start[e], end[e], seq[e]) != (begin, end[i], seq[i]):
                        pool.append(e)
                best = max(pool, key=score.__getitem__)
            skip = end[best]
            kept.append(best)
        return kept

    def kept(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the kept spans of sorted arrays, in emit order: place among all spans of the arrays, array, number of the island within
        the array, order within the island; and where each array begins."""
        start, end, edges, first = begins(spans)
        flat = spans.flatten()
        # a score that is missing wins nothing
        score = np.nan_to_num(np.asarray(flat.field("score").fill_null(-math.inf)), nan=math.inf, posinf=math.inf, neginf=-math.inf).tolist()
        start, end, seq = start.tolist(), end.tolist(), flat.field("seq").to_numpy(zero_copy_only=False).tolist()
        isles = np.append(np.flatnonzero(first), len(first))
        at, own = [], []  # kept spans, and how many of them each island has
        for begin, last in zip(isles[:-1].tolist(), isles[1:].tolist()):
            chosen = [begin] if last - begin == 1 else walk(begin, last, start, end, seq, score)
            at += chosen
            own.append(len(chosen))
        own, at = np.array(own, np.int64), np.array(at, np.int64)
        row_of_isle = np.searchsorted(edges, isles[:-1], side="right") - 1
        isles_of_row = np.bincount(row_of_isle, minlength=len(spans))
        isle = np.repeat(np.arange(len(own)), own)
        row = row_of_isle[isle]
        pos = np.arange(len(at)) - (np.cumsum(own) - own)[isle]
        number = isle - (np.cumsum(isles_of_row) - isles_of_row)[row]
        return at, row, number, pos, edges

    return kept


def kept_places(sorted_spans: Column, mode: str = "compat") -> Column:
    """``array<struct<at,island,pos>>`` of the kept spans, in emit order: the place of each in ``sorted_spans`` (an array of ``struct<start,
    end,seq,score>`` sorted by ``sort_array``), the number of its island from 0 and its order within the island. A null array keeps none.

    All functions are made here, so that they travel with the task and workers need not import this package.
    """
    kept = chooser(mode)
    place = pa.struct([("at", pa.int32()), ("island", pa.int32()), ("pos", pa.int32())])

    def kept_in(spans: pa.Array) -> pa.Array:
        at, row, number, pos, edges = kept(spans)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(spans)))])
        values = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (at - edges[row], number, pos)], fields=list(place))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for spans in batches:
            ends = np.cumsum(np.asarray(spans.value_lengths().fill_null(0)), dtype=np.int64)
            parts, first = [], 0
            while first < len(spans):
                last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, side="right")), first + 1)
                parts.append(kept_in(spans.slice(first, last - first)))
                first = last
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(place))

    places.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(places, "array<struct<at:int,island:int,pos:int>>")(sorted_spans)
