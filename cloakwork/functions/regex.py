"""Regex dialect and match offsets as Column expressions.

Rules are written in Python's ``re`` dialect, where ``\\w``, ``\\d``, ``\\s`` and ``\\b`` follow
Unicode. Spark matches with Java's engine, whose shorthands are ASCII or differ in detail (combining
marks, superscripts, control separators), so the shorthands are spelled out as explicit classes.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The literal astral letter adds nothing to the class (it is a letter already); it makes Java step back
# by whole code points in a look-behind instead of by UTF-16 units.
_BEHIND = f"[{WORD}\U00010000]"
BOUNDARY = f"(?:(?<={_BEHIND})(?![{WORD}])|(?<!{_BEHIND})(?=[{WORD}]))"
_CLASSES = {"w": WORD, "d": DIGIT, "s": SPACE}
# Python's [A-Za-z] without regard to case also takes these four letters.
ANY_CASE = r"A-Za-zİıſK"
# The same for a text of ASCII characters alone. There Java's own boundary is right and costs next to nothing.
ASCII_DIGIT = "0123456789"
ASCII_WORD = f"{ASCII_DIGIT}ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"
_ASCII_CLASSES = {"w": ASCII_WORD, "d": ASCII_DIGIT, "s": r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "}
_ASCII_BOUNDARY = r"\b"


def _spelled(pattern: str, ascii_only: bool = False) -> str:
    """Shorthands and ASCII ranges written out. Java looks up listed characters in one table, but walks
    through ranges one by one, so a list is several times faster than the same ranges."""
    classes, boundary = (_ASCII_CLASSES, _ASCII_BOUNDARY) if ascii_only else (_CLASSES, BOUNDARY)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            code = re.match(r"\\u[0-9A-Fa-f]{4}(-\\u[0-9A-Fa-f]{4})?", pattern[i:])
            if code:
                out.append(code.group())
                i += len(code.group())
                continue
            i += 2
            if nxt in classes:
                out.append(classes[nxt] if in_class else f"[{classes[nxt]}]")
            elif nxt == "b" and not in_class:
                out.append(boundary)
            else:
                out.append(ch + nxt)
            continue
        span = in_class and re.match(r"[0-9]-[0-9]|[A-Z]-[A-Z]|[a-z]-[a-z]", pattern[i:])
        if span:
            out.append("".join(map(chr, range(ord(ch), ord(pattern[i + 2]) + 1))))
            i += 3
            continue
        if in_class and ch == "-":
            ch = r"\-"
        elif ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


# Equal but faster beginnings of a rule. The run before an "@" cannot hold one, so it need not be given
# back; and a match can only begin inside such a run where the last match ended or, with a boundary in
# front, next to one of the run's other characters. Without this, a long run costs its length squared.
_LOCAL = "[A-Za-z0-9._%+-]"


def _faster(ascii_only: bool) -> dict[str, str]:
    letters, boundary = ("A-Za-z", _ASCII_BOUNDARY) if ascii_only else (ANY_CASE, BOUNDARY)
    run = _spelled(f"[{letters}0-9._%+-]")
    return {
        rf"\b{_LOCAL}+@": rf"(?:(?<!{run})|(?<=[.%+\-])|(?=[.%+\-]))(?={run}++@){boundary}{run}++@",
        rf"{_LOCAL}+@": rf"(?:\G|(?<!{run})){run}++@",
    }


def to_java(pattern: str, ignore_case: bool = False, ascii_only: bool = False) -> str:
    """Spell a Python pattern for Java's engine with the same matches; ``ascii_only``: the same in texts of ASCII characters."""
    head, flags = "", ""
    any_case = "A-Za-z" if ascii_only else ANY_CASE
    if ignore_case:
        for slow, fast in _faster(ascii_only).items():
            if pattern.startswith(slow):
                head, pattern = fast, pattern[len(slow) :]
                break
        # Java's case-blind classes are slow; whole alphabets can be written out instead
        spelled = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"A-Z(\|?)a-z", rf"{any_case}\1", m.group()), pattern)
        if re.search(r"[A-Za-z]", re.sub(r"\\u[0-9A-Fa-f]{4}|\\.", "", spelled.replace(any_case, ""))):
            flags = "(?iu)"
        else:
            pattern = spelled
    body = head + _spelled(pattern, ascii_only)
    if body.startswith(BOUNDARY):
        # The spelled-out boundary costs far more than the first characters of the rule: look at those first.
        body = f"(?={body[len(BOUNDARY):]}){body}"
    return flags + body


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Set around each match. A text that holds one of these is taken apart by the pattern itself, which is
# slower, for Java then compiles the pattern for every text.
_OPEN, _CLOSE = "\x01", "\x02"
_BLOCK = 64
_FEW = 9


def has_marks(text: str) -> str:
    return f"contains({text}, '{_OPEN}') or contains({text}, '{_CLOSE}')"


def marked(text: str, regex: str, plain: str, marks: str, ascii_only: str) -> str:
    """SQL for the text with marks around every match of a constant ``regex``; null if ``marks``. ``plain`` is the same
    expression spelled for a text of which ``ascii_only`` holds."""
    around = f"'{_OPEN}$0{_CLOSE}'"
    return f"""case when {marks} then null when {ascii_only} then regexp_replace({text}, {plain}, {around})
        else regexp_replace({text}, {regex}, {around}) end"""


def has_match(text: str, cut: str) -> str:
    """SQL for whether a ``marked`` text holds a match; where it is null, the text has been tested before."""
    return f"{cut} is null or octet_length({cut}) > octet_length({text})"


def match_offsets(text: str, cut: str, regex: str, seq: str, score: float) -> str:
    """SQL for ``array<struct<start,end,seq,score>>``, one per match, from a ``marked`` text.

    Spark has no function for all match offsets. Matches and the pieces between them alternate, so a
    running sum of their lengths gives code-point offsets. No rule matches the empty string.

    The pieces are made once. A single match, the usual case, is read off them; a few look back at the lengths of all pieces
    before them. For more, sums are taken by blocks, so that no match looks back further than its own block; a fold copies
    its state at every step, so no array is built up in one.
    """
    pieces = f"if({cut} is null, split({text}, {regex}, -1), split({cut}, '{_OPEN}', -1))"

    def match_length(piece: str) -> str:
        return f"length(substring_index({piece}, '{_CLOSE}', 1))"

    def here(start: str, length: str) -> str:
        return f"named_struct('start', {start}, 'end', {start} + {length}, 'seq', {seq}, 'score', cast({score} as double))"

    one = f"array({here('length(ps[0])', match_length('ps[1]'))})"
    # every piece but the first holds one mark
    before = "aggregate(slice(ls, 1, i + 1), 0, (n, y) -> n + y) - i"
    few = f"""element_at(transform(array(transform(ps, y -> length(y))), ls -> transform(slice(ps, 2, size(ps) - 1),
        (x, i) -> {here(f"({before})", match_length("x"))})), 1)"""
    usual = f"""transform(slice(ps, 2, greatest(size(ps) - 1, 0)),
        x -> named_struct('len', {match_length("x")}, 'gap', length(x) - {match_length("x")} - 1))"""
    odd = f"""zip_with(regexp_extract_all({text}, {regex}, 0), slice(ps, 2, greatest(size(ps) - 1, 0)),
        (m, p) -> named_struct('len', length(m), 'gap', length(p)))"""

    def total(of: str) -> str:
        return f"aggregate({of}, 0, (n, x) -> n + x.len + x.gap)"

    block = f"slice(g, b * {_BLOCK} + 1, {_BLOCK})"
    blocks = f"sequence(0, greatest(cast(ceil(size(g) / {_BLOCK}) as int), 1) - 1)"
    each = f"""transform(k, (x, i) -> element_at(transform(array(
        length(ps[0]) + aggregate(slice(sums, 1, b), 0, (n, y) -> n + y) + {total("slice(k, 1, i)")}), p -> {here("p", "x.len")}), 1))"""
    placed = f"flatten(transform({blocks}, b -> flatten(transform(array({block}), k -> {each}))))"
    many = f"""element_at(transform(array(if({cut} is null, {odd}, {usual})), g ->
        element_at(transform(array(transform({blocks}, b -> {total(block)})), sums -> {placed}), 1)), 1)"""
    return f"""element_at(transform(array({pieces}), ps -> case when {cut} is not null and size(ps) = 2 then {one}
        when {cut} is not null and size(ps) between 3 and {_FEW} then {few} else {many} end), 1)"""
