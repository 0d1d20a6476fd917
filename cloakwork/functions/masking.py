"""Numbering, replacement values and splicing of kept spans, as array expressions per text.

Findings are numbered from the end of the text, per type: the last e-mail address is number 1. Equal
values get different tokens unless the strategy says otherwise.
"""

from __future__ import annotations

from cloakwork.functions.regex import sql_string
from cloakwork.functions.tokens import token

FOUND = (
    "array<struct<entity_type:string,start:int,end:int,score:double,text:string,pattern:string,"
    "pos:int,token:string>>"
)

STRATEGIES = ("REPLACE", "REDACT", "TRUNCATE", "HASH", "TOKENIZE", "SYNTHETIC")

# Made-up stand-ins for SYNTHETIC; a value always gets the same one.
SYNTHETIC_VALUES = {
    "EMAIL_ADDRESS": ["alex@example.com", "sam@example.org", "kim@example.net", "robin@example.com"],
    "PHONE_NUMBER": ["(555) 010-0001", "(555) 010-0002", "(555) 010-0003", "(555) 010-0004"],
    "CREDIT_CARD": ["0000-0000-0000-0001", "0000-0000-0000-0002", "0000-0000-0000-0003"],
    "US_SSN": ["000-00-0001", "000-00-0002", "000-00-0003"],
    "IP_ADDRESS": ["192.0.2.1", "192.0.2.2", "192.0.2.3"],
    "PERSON": ["Alex Example", "Sam Sample", "Kim Placeholder"],
}
SYNTHETIC_OTHER = ["sample-1", "sample-2", "sample-3"]


# Spark finds a place in a text by walking there from its beginning. Where a text has many findings, it is cut into pieces
# of known length first, so that each walk is short.
_MANY, _PIECE, _BLOCK = 64, 1024, 65_536


def _pieces(text: str, found: str) -> str:
    """SQL for the text's pieces, or an empty array where that isn't worth while."""
    inner = f"transform(sequence(0, {_BLOCK // _PIECE - 1}), i -> substring(t, i * {_PIECE} + 1, {_PIECE}))"
    blocks = f"transform(sequence(0, cast(length({text}) div {_BLOCK} as int)), b -> substring({text}, b * {_BLOCK} + 1, {_BLOCK}))"
    return f"if(size({found}) > {_MANY}, flatten(transform({blocks}, t -> {inner})), cast(array() as array<string>))"


def _cut(text: str, start: str, length: str) -> str:
    """SQL for part of the text from ``start`` (from 0), with the pieces at hand as ``cs``."""
    at = f"cast(({start}) div {_PIECE} as int)"
    near = f"concat(coalesce(get(cs, {at}), ''), coalesce(get(cs, {at} + 1), ''))"
    return f"""if(size(cs) > 0 and {length} <= {_PIECE}, substring({near}, ({start}) % {_PIECE} + 1, {length}),
        substring({text}, {start} + 1, {length}))"""


def _with_pieces(text: str, found: str, sql: str) -> str:
    return f"element_at(transform(array({_pieces(text, found)}), cs -> {sql}), 1)"


def decorated(kept: str, text: str, labels: str) -> str:
    """SQL turning kept spans into findings; ``labels`` maps ``seq`` to entity type and pattern.

    The result is ordered by descending start; spans with the same start stay in emit order.
    """
    return _with_pieces(text, kept, f"""transform(array_sort(transform({kept}, (k, i) -> named_struct(
            'back', -k.start, 'pos', i, 'k', k, 'l', {labels}))),
        o -> named_struct('entity_type', o.l.entity_type, 'start', o.k.start, 'end', o.k.end,
            'score', o.k.score, 'text', {_cut(text, "o.k.start", "o.k.end - o.k.start")},
            'pattern', o.l.pattern, 'pos', o.pos))""")


def described(kept: str, text: str, labels: str) -> str:
    """SQL turning spans of ``scan.kept_spans`` into the same findings."""
    return _with_pieces(text, kept, f"""transform(transform({kept}, k -> named_struct('k', k, 'l', {labels})),
        o -> named_struct('entity_type', o.l.entity_type, 'start', o.k.start, 'end', o.k.end,
            'score', o.k.score, 'text', {_cut(text, "o.k.start", "o.k.end - o.k.start")},
            'pattern', o.l.pattern, 'pos', o.k.pos))""")


def numbered(found: str, strategy: str, salt: str) -> str:
    """SQL adding ``token`` to findings that are ordered by descending start.

    Numbers come from positions within one type, so the work is linear in the findings of a text.
    """
    per_type = f"transform(filter({found}, f -> f.entity_type = t), (f, n) -> {_with_token(strategy, salt)})"
    return f"""transform(array_sort(transform(flatten(transform(
            array_distinct(transform({found}, f -> f.entity_type)), t -> {per_type})),
            f -> named_struct('back', -f.start, 'pos', f.pos, 'f', f))), o -> o.f)"""


def _with_token(strategy: str, salt: str) -> str:
    fields = ", ".join(f"'{c}', f.{c}" for c in ("entity_type", "start", "end", "score", "text", "pattern", "pos"))
    return f"named_struct({fields}, 'token', {replacement(strategy, salt)})"


def replacement(strategy: str, salt: str = "") -> str:
    """SQL for what stands in for finding ``f``, the ``n``-th (from 0) of its type."""
    if strategy == "REPLACE":
        return token("f.entity_type", "n + 1")
    if strategy == "REDACT":
        return "'[REDACTED]'"
    if strategy == "TRUNCATE":
        # user@mail.example.com -> user@***.com; anything else keeps its last four characters
        return (
            "if(f.entity_type = 'EMAIL_ADDRESS' and contains(f.text, '@'), "
            r"regexp_replace(f.text, '@.*\\.', '@***.'), "
            "concat('***', substring(f.text, greatest(length(f.text) - 3, 1), 4)))"
        )
    if strategy == "HASH":
        return f"sha2(concat({sql_string(salt)}, f.text), 256)"
    if strategy == "TOKENIZE":
        # The number is the whole digest of the value, so equal values share a token in every text and no others do.
        blocks = [(15, 19)] * 4 + [(4, 5)]
        parts = [f"lpad(conv(substring(h, {1 + 15 * i}, {n}), 16, 10), {d}, '0')" for i, (n, d) in enumerate(blocks)]
        digest = f"sha2(concat({sql_string(salt)}, f.entity_type, ':', f.text), 256)"
        return token("f.entity_type", f"element_at(transform(array({digest}), h -> concat({', '.join(parts)})), 1)")
    if strategy == "SYNTHETIC":
        def pick(values: list[str]) -> str:
            table = ", ".join(sql_string(v) for v in values)
            number = f"cast(conv(substring(sha2(concat({sql_string(salt)}, f.text), 256), 1, 15), 16, 10) as bigint)"
            return f"array({table})[cast({number} % {len(values)} as int)]"

        cases = " ".join(f"when {sql_string(t)} then {pick(v)}" for t, v in SYNTHETIC_VALUES.items())
        return f"case f.entity_type {cases} else {pick(SYNTHETIC_OTHER)} end"
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def token_pairs(kept: str, text: str, kind: str) -> str:
    """SQL for tokens and values of spans ``f`` of ``scan.kept_spans``; ``kind`` maps ``f`` to its entity type."""
    return _with_pieces(text, kept, f"""transform({kept}, f -> named_struct('token', {token(kind, "f.n")},
        'value', {_cut(text, "f.start", "f.end - f.start")}))""")


def spliced(found: str, text: str, token: str = "f.token") -> str:
    """SQL replacing findings (descending start) in the text by their tokens.

    Without overlaps the text is put together from the pieces between findings. Where kept findings
    overlap, each replacement works on the text as the one before left it, at unchanged offsets.
    """
    overlap = f"exists(sequence(0, size({found}) - 2), i -> {found}[i + 1].end > {found}[i].start)"
    before = f"if(i = 0, 0, {found}[size({found}) - i].end)"
    joined = f"""array_join(transform({found_ascending(found)}, (f, i) -> concat(
        {_cut(text, before, f"f.start - {before}")}, {token})), '')"""
    pieces = f"concat({_with_pieces(text, found, joined)}, substring({text}, {found}[0].end + 1))"
    fold = f"""aggregate({found}, {text}, (acc, f) ->
        concat(substring(acc, 1, f.start), {token}, substring(acc, f.end + 1)))"""
    return f"""case when {text} is null or size({found}) <= 0 then {text}
        when size({found}) > 1 and {overlap} then {fold} else {pieces} end"""


def found_ascending(found: str) -> str:
    return f"reverse({found})"
