"""Rule matching over batches of texts, with Arrow's regular expressions (RE2) inside Spark's tasks.

Java tries a rule at every place of a text anew; RE2 reads the text once for a rule, a whole batch in one call. It knows no look-around
and only ASCII boundaries, so it takes the texts and the rules for which that makes no difference; ``detection`` does the others.

Most rules see no more of a character beyond ASCII than whether it is a letter, white space or neither. For them a text is *folded*: each
such character is replaced by one of three that stand for these kinds and that the rule names nowhere.

``match_spans`` leaves to Java what RE2 cannot read. ``kept_spans`` leaves nothing: rules that see more run by Python's own ``re``, over the
texts that a wider expression lets through, and overlaps are settled in the same step.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.overlap import chooser
from cloakwork.functions.regex import _LOCAL, ASCII_WORD, _spelled
from cloakwork.sources.rules import EMAIL_ADDRESS

# Texts are taken in slices of so many bytes, or one by one where they are longer.
SLICE = 4 << 20
# Rules that match in none of so many texts of a slice are first tried together on the others.
SAMPLE = 64

_IN_CLASS = r"\\[^A-Za-z0-9]|\\[tnr]|\\x[0-9a-f]{2}|[^\\\[\]]"
# Classes, groups, alternatives, repeats and literals: what all engines read alike.
_COMMON = re.compile(
    rf"(?:\[\^?(?:{_IN_CLASS})+\]|\(\?:|\((?!\?)|\)|\||(?:[*+?]|\{{[0-9]+(?:,[0-9]*)?\}})(?![+*{{])\??"
    r"|\\[^A-Za-z0-9]|\\[btnr]|\\x[0-9a-f]{2}|[^\\^$.|?*+()\[\]{}])+"
)
_BEYOND_ASCII = re.compile(r"\\u(?!00[0-7])[0-9A-Fa-f]{4}(?:-\\u[0-9A-Fa-f]{4})?")


@lru_cache(maxsize=4096)
def to_re2(pattern: str, ignore_case: bool = False) -> str | None:
    """A Python pattern spelled for RE2 with the same matches in ASCII texts; None if it has parts that the two may read
    differently, or may match the empty string."""
    spelled = _spelled(re.sub(r"\[[^\]]*\]", lambda m: _BEYOND_ASCII.sub("", m.group()), pattern), ascii_only=True)
    if not spelled.isascii() or not _COMMON.fullmatch(spelled):
        return None
    spelled = ("(?i)" if ignore_case else "") + spelled
    try:
        pc.match_substring_regex(pa.array([""]), pattern=spelled)
    except pa.ArrowInvalid:
        return None
    probes = ("aa aa", "00 00", "")
    return None if any(m.start() == m.end() for probe in probes for m in re.finditer(pattern, probe)) else spelled


# What stands for letters and numbers, white space and all others in a folded text. The last also stands for the characters 1 and 2.
_LETTER, _SPACE, _OTHER = "_", "\x1f", "\x03"
# Other digits than ASCII's: a text that holds one is not folded.
OTHER_DIGIT = r"[\p{Nd}&&[^0-9]]"


def foldable(pattern: str, ignore_case: bool = False) -> bool:
    """Whether a Python pattern has the same matches in a folded text: no literal and no class names what stands for others, or letters
    beyond ASCII."""
    if ignore_case or re.search(r"_|\\[xuUN0-7]|[\x00-\x1f]", pattern):
        return False
    for found in re.finditer(r"\[\^?((?:\\.|[^\]\\])+)\]", pattern):
        named = re.sub(r"\\[wdsWDS]", "", found.group(1))
        if named.strip("-") and re.search(f"[{named.removeprefix('^')}]", _LETTER + _SPACE + _OTHER):
            return False
    return True


# A rule with look-around whose body tells as much: the body's matches that begin a text or follow white space, and end before a character
# that can go on none. A run of the body's characters holds no white space and no such end, so no match that is passed over hides another.
_APART = EMAIL_ADDRESS["unicode"]
_APART_BODY = _APART.removeprefix(r"(?:^|(?<=\s))").removesuffix(r"(?=\s|$|[^\w.-])")


def scannable(pattern: str, ignore_case: bool = False) -> bool:
    """Whether ``kept_spans`` takes a Python pattern: one that all engines read alike, or the one rule above."""
    return pattern == _APART or to_re2(pattern, ignore_case) is not None


def _widens(pattern: str, ignore_case: bool) -> bool:
    """Whether a pattern matches in a folded text with ASCII digits for others wherever it matches in the text itself."""
    return not ignore_case and "[^" not in pattern and not re.search(r"\\[xuUN0-7]|[\x00-\x1f]", pattern)


def _behind_run(pattern: str) -> tuple[str, bool] | None:
    """What a pattern that begins with a run of address characters and an "@" asks for from the "@" on, and whether the run begins at a
    boundary; null for others. Python's ``re`` would take the square of a long run's length to find that it ends in no "@"."""
    bounded = pattern.startswith(rf"\b{_LOCAL}+@")
    tail = pattern.removeprefix(r"\b").removeprefix(f"{_LOCAL}+")
    if not (bounded or pattern.startswith(f"{_LOCAL}+@")) or "|" in re.sub(r"\[[^\]]*\]", "", tail):
        return None
    return tail, bounded


@lru_cache(maxsize=2)
def _kinds(digits: bool = False) -> tuple[bytes, bytes]:
    """Runs of code points with one stand-in: their lengths and the stand-ins. With ``digits``, ASCII's stand for all others."""

    def stand_in(c: str) -> str:
        if digits and c.isdecimal():
            return str(int(c))
        return _SPACE if c.isspace() else _LETTER if c.isalnum() else _OTHER

    ascii_part = bytes(range(128)).replace(b"\x01", _OTHER.encode()).replace(b"\x02", _OTHER.encode())
    rest = "".join(map(stand_in, map(chr, range(128, sys.maxunicode + 1))))
    codes = np.frombuffer(ascii_part + rest.encode(), np.uint8)
    begins = np.flatnonzero(np.diff(codes, prepend=np.uint8(255)))
    return np.diff(begins, append=len(codes)).astype(np.int32).tobytes(), codes[begins].tobytes()


def match_spans(text: Column, rules: list[tuple[int, str, str | None, bool]], score: float) -> Column:
    """``array<struct<start,end,seq,score>>`` of every match in ``text``, by start. A rule is ``(seq, pattern, gate, folded)``, spelled for
    RE2; it is only run over texts in which its gate matches. Texts that are not of ASCII characters, or hold the characters 1 or 2, go
    through the rules that are ``folded`` only. A null text has none.
    """
    found_in, slices = _finder([(*rule, False, None) for rule in rules], score)

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [found_in(part) for part in slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(span))

    span = _SPAN_TYPE
    spans.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(spans, "array<struct<start:int,end:int,seq:int,score:double>>")(text)


def kept_spans(text: Column, rules: list[tuple[int, str, str, bool, str | None]], score: float, mode: str = "compat") -> Column:
    """``KEPT`` of the matches in ``text`` that are kept where they overlap (see ``overlap``), by descending start: ``pos`` is the place in
    emit order, which also orders matches with the same start, and ``n`` the number within the kind, from 1. A rule is ``(seq, kind,
    pattern, ignore_case, gate)``, a ``scannable`` Python pattern. A null text has none.
    """
    known, kinds = [], {}
    for seq, kind, pattern, ignore_case, gate in rules:
        kinds[seq] = kind
        apart = pattern == _APART
        spelled = to_re2(_APART_BODY if apart else pattern, ignore_case)
        whole = (pattern, _behind_run(pattern), ignore_case, not apart and _widens(pattern, ignore_case))
        known.append((seq, spelled, gate, apart or foldable(pattern, ignore_case), apart, whole))
    found_in, slices = _finder(known, score)
    names = sorted(set(kinds.values()))
    kind_of = np.array([names.index(kinds[seq]) if seq in kinds else -1 for seq in range(max(kinds) + 1)])
    kept, span = chooser(mode), pa.struct([*_SPAN_TYPE, ("pos", pa.int32()), ("n", pa.int32())])

    def kept_in(texts: pa.Array) -> pa.Array:
        found = found_in(texts)
        at, row, *_ = kept(found)
        edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
        pos = np.arange(len(at)) - edges[row]
        start, end, seq, scores = (c.to_numpy()[at] for c in found.flatten().flatten())
        order = np.lexsort((pos, -start, row))
        start, end, seq, scores, pos = (c[order] for c in (start, end, seq, scores, pos))
        # of matches of one kind in one text, how many lie before
        group = row * (len(kind_of) + 1) + kind_of[seq]
        alike = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[alike], prepend=-1))
        n = np.empty(len(at), np.int64)
        n[alike] = 1 + np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        columns = [pa.array(c.astype(np.int32)) for c in (start, end, seq)] + [pa.array(scores)] + [pa.array(c.astype(np.int32)) for c in (pos, n)]
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(span)))

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [kept_in(part) for part in slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(span))

    spans.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(spans, KEPT)(text)


KEPT = "array<struct<start:int,end:int,seq:int,score:double,pos:int,n:int>>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seq", pa.int32()), ("score", pa.float64())])


def _finder(rules: list[tuple[int, str, str | None, bool, bool, tuple | None]], score: float) -> tuple[Callable, Callable]:
    """A function for the matches in an array of texts, and one that cuts such arrays into slices for it. A rule is ``(seq, pattern, gate,
    folded, apart, whole)``; ``apart`` rules are only the body of ``_APART``. ``whole`` tells how Python's ``re`` runs the rule, over the
    texts that its pattern cannot read: as the Python pattern, ``_behind_run``, whether case is ignored, whether it ``_widens``. Where it is
    null, nothing does.

    All functions are made here, so that they travel with the task and workers need not import this package.
    """
    lengths, stand_ins = _kinds(any(rule[-1] for rule in rules))
    span, sample = _SPAN_TYPE, SAMPLE
    address = {chr(c) for c in range(128) if re.match(_LOCAL, chr(c))}
    address_any_case = address | set("\u0130\u0131\u017f\u212a")
    space, mail = (np.isin(np.arange(256), list(c.encode())) for c in ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", ASCII_WORD + ".-"))

    def slices(texts: pa.Array) -> Iterator[pa.Array]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            begun = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, begun + SLICE, side="right")), first + 1)
            yield texts.slice(first, last - first)
            first = last

    def places(marked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each match, from texts with a 1 before and a 2 behind every match; each has one."""
        _, offsets, data = marked.buffers()
        offsets = np.frombuffer(offsets, np.int64)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        is_mark = np.zeros(-(-len(data) // 8) * 8, bool)
        np.less(data - np.uint8(1), 2, out=is_mark[: len(data)])
        # marks are few: eight bytes at a time are looked at first
        eights = np.flatnonzero(is_mark.view(np.uint64))
        which, byte = np.nonzero(is_mark.reshape(-1, 8)[eights])
        marks = 8 * eights[which] + byte
        opened, closed = marks[::2], marks[1::2]
        row = np.searchsorted(offsets, opened, side="right") - 1
        per_row = np.bincount(row, minlength=len(marked))
        before = 2 * (np.arange(len(row)) - (np.cumsum(per_row) - per_row)[row]) + offsets[row]
        return row, opened - before, closed - before - 1

    def folded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts folded, a byte for each character, which of them did not need it, and which got an ASCII digit for another."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        odd = np.flatnonzero((data >= 128) | (data - np.uint8(1) < 2))
        if not len(odd):
            return texts, np.ones(len(texts), bool), np.zeros(len(texts), bool)
        plain = np.searchsorted(odd, offsets[1:]) == np.searchsorted(odd, offsets[:-1])
        whole = odd[data[odd] >= 192]  # first bytes of longer characters
        after = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b, c, d = (after[whole + i].astype(np.int32) for i in range(4))
        code = (a & 31) << 6 | b & 63
        code = np.where(a >= 224, (a & 15) << 12 | (b & 63) << 6 | c & 63, code)
        code = np.where(a >= 240, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63, code)
        table = np.repeat(np.frombuffer(stand_ins, np.uint8), np.frombuffer(lengths, np.int32))
        out = data.copy()
        out[odd] = table[np.minimum(data[odd], 127)]
        out[whole] = kinds = table[np.minimum(code, len(table) - 1)]
        digits = whole[kinds - np.uint8(48) < 10]
        odder = np.searchsorted(digits, offsets[1:]) > np.searchsorted(digits, offsets[:-1])
        first = (data & 192) != 128
        ends = offsets - np.searchsorted(np.flatnonzero(~first), offsets)
        buffers = [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out[first].tobytes())]
        return pa.Array.from_buffers(pa.large_string(), len(texts), buffers), plain, odder

    def tried_together(patterns: list[str], texts: pa.Array) -> np.ndarray | None:
        """In which texts any of the patterns matches; null if they are too long together."""
        try:
            return pc.match_substring_regex(texts, pattern="|".join(f"(?:{p})" for p in patterns)).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:
            return None

    def matches(text: str, pattern: str, behind: tuple[str, bool] | None, flags: int) -> Iterator[tuple[int, int]]:
        if not behind:
            yield from (found.span() for found in re.finditer(pattern, text, flags))
            return
        tail, bounded = re.compile(behind[0], flags), behind[1]
        taken = address_any_case if flags else address
        done, at = 0, text.find("@")
        while at >= 0:
            # the run holds no "@", so it ends here and a match begins as far before as it may
            start = at
            while start > done and text[start - 1] in taken:
                start -= 1
            if bounded:
                word = [c == "_" or c.isalnum() for c in text[max(start - 1, 0) : at + 1]]
                if not start:
                    word.insert(0, False)
                start = next((start + i for i in range(at - start) if word[i] != word[i + 1]), at)
            found = tail.match(text, at) if start < at else None
            if found:
                yield start, found.end()
                done = found.end()
            at = text.find("@", found.end() if found else at + 1)

    def apart_only(row: np.ndarray, start: np.ndarray, end: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which matches of the body of ``_APART`` in the texts are its own."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)
        first, last = offsets[row] + start, offsets[row] + end
        begins = (start == 0) | space[data[np.maximum(first - 1, 0)]]
        return begins & ((last == offsets[row + 1]) | ~mail[data[np.minimum(last, len(data) - 1)]])

    def found_in(texts: pa.Array) -> pa.Array:
        rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        texts_of = texts.drop_null().cast(pa.large_string())
        filled, plain, odder = folded(texts_of)
        groups = {}
        for rule in rules:
            groups.setdefault((rule[2], rule[3]), []).append(rule)
        out = []
        for (gate, fold), some_rules in groups.items():
            through = pc.match_substring_regex(filled, pattern=gate).to_numpy(zero_copy_only=False) if gate else np.ones(len(filled), bool)
            read = through & ~odder if fold else through & plain
            own, some = np.flatnonzero(read), filled.filter(pa.array(read))
            few, rare = some.slice(0, sample), []
            if len(some) > 4 * sample:
                rare = [r[0] for r in some_rules if not pc.any(pc.match_substring_regex(few, pattern=r[1])).as_py()]
            any_rare = tried_together([r[1] for r in some_rules if r[0] in rare], some) if len(rare) > 1 else None
            own_rare, some_rare = (own[any_rare], some.filter(pa.array(any_rare))) if any_rare is not None else (own, some)
            for seq, pattern, _, _, apart, _ in some_rules:
                mine, those = (own_rare, some_rare) if seq in rare else (own, some)
                if not len(mine):
                    continue
                marked = pc.replace_substring_regex(those, pattern=pattern, replacement="\x01\\0\x02")
                hit = pc.not_equal(pc.binary_length(marked), pc.binary_length(those))
                mine = mine[hit.to_numpy(zero_copy_only=False)]
                if len(mine):
                    row, start, end = places(marked.filter(hit))
                    if apart:
                        is_one = apart_only(row, start, end, those.filter(hit))
                        row, start, end = row[is_one], start[is_one], end[is_one]
                    out.append((rows[mine[row]], start, end, np.full(len(row), seq)))
            unread = through & ~read
            if not unread.any():
                continue
            own, some = np.flatnonzero(unread), filled.filter(pa.array(unread))
            for seq, pattern, _, _, _, whole in some_rules:
                if not whole:
                    continue
                python, behind, ignore_case, widens = whole
                flags = re.IGNORECASE if ignore_case else 0
                mine = own[pc.match_substring_regex(some, pattern=pattern).to_numpy(zero_copy_only=False)] if widens else own
                each = [(rows[i], *at, seq) for i in mine.tolist() for at in matches(texts_of[i].as_py(), python, behind, flags)]
                if each:
                    out.append(tuple(np.array(c, np.int64) for c in zip(*each)))
        row, start, end, seq = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((seq, end, start, row))
        columns = [c[order].astype(np.int32) for c in (start, end, seq)] + [np.full(len(row), score)]
        ends = np.cumsum(np.bincount(row, minlength=len(texts)))
        values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(span))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)

    return found_in, slices
