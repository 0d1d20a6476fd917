"""Secrets by assignment-aware lexing.

Three plain patterns come first, each leftmost and non-overlapping over the whole text, with matches that are too short
dropped: ``assign`` (a sensitive word, ``:`` or ``=``, and a value), ``access`` (keys that begin with ``AKIA``) and ``hex``.

Then the text is read as source code and configuration at once. Every ``=``, ``:``, ``:=`` or ``=>`` that stands between a
name and a value makes a pair: ``NAME = "x"``, ``name: str = 'x'``, ``"name": "x"``, ``obj["name"] = "x"``, ``name: x`` to the
end of a line, ``f(name="x")``, ``--name=x``. A value is one literal, one name, or several of them joined by ``+``, ``.`` or ``||``.
A literal belongs to all names it is assigned to, and a name's literals also belong to the names that it is assigned to, over any number
of steps (``a = "x"``, ``b = a``, ``password = b``), wherever in the text these stand. A literal's score is how sensitive the
most sensitive of its names is, times how much it looks like a secret and not like a word, a place-holder, a path or a
template. Literals that score ``LEAST`` or more, and lie in no span of the plain patterns, are spans of the kind
``named``. The work is linear in the text: a name is at most 128 characters long, a literal 4,096.

Spans count code points, the end is exclusive. Null and empty texts have none; rows of one id, or without id, and repeated rows are
judged one by one; extra columns are left behind; an empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.texts import raw_texts, small_batches

KINDS = ("assign", "access", "hex", "named")
LEAST = 0.5

# the plain patterns and least lengths, as stated by the contract; on bytes, where lower case means A-Z only
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Start, end (in bytes) and kind of the plain patterns' matches, in order."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(raw.lower()) if m.end() - m.start(1) >= 12]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex") for m in _HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ------------------------------------------------------------------ pairs of names and values

_MARK = re.compile(rb"[=:]")
# an operator is none behind or before these: ==, !=, <=, +=, ::, ://
_NOT_BEHIND, _NOT_BEFORE = b"=!<>:+*/%&|^~-", b"=:"
_LEFT = re.compile(rb"""(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]{0,127}+)["']?\]?(?:\x20?:\x20?(?P<note>[A-Za-z_]\w{0,40}+)[\w.\[\]]{0,40}+)?[\x20\t]{0,16}+\Z""")
_REACH = 256
_STRING = re.compile(rb"""[rbfuRBFU]{0,2}(?:"(?P<double>(?:[^"\\\n]|\\.){0,4096}+)"|'(?P<single>(?:[^'\\\n]|\\.){0,4096}+)'|`(?P<back>[^`\\\n]{0,4096}+)`)""")
_NAME = re.compile(rb"(?:\$\{?)?(?P<name>[A-Za-z_][\w.]{0,127}+)\}?(?![\w(/@:+=-])")
_BARE = re.compile(rb"""[^\s"'`,;()\[\]{}<>]{1,4096}+(?=[\x20\t]{0,16}(?:[\r\n,;#)\]}]|//|\Z))""")
_DOTTED = re.compile(rb"[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)+\Z")
_JOIN = re.compile(rb"[\x20\t]{0,16}(?:\+|\|\||\.(?=[\x20\t\"'$]))[\x20\t\n]{0,16}")
_SPACE = re.compile(rb"[\x20\t]{0,16}")


def _key(name: bytes) -> bytes:
    return name.lower().removeprefix(b"this.").removeprefix(b"self.").lstrip(b"$-.").rstrip(b".-")


def pairs(raw: bytes) -> Iterator[tuple[bytes, list[tuple[int, int]], list[tuple[int, int]], list[bytes]]]:
    """Per assignment: the name as written, its value's quoted literals and bare words as spans, and the names in its value."""
    for m in _MARK.finditer(raw):
        at = m.start()
        if not at or raw[at - 1] in _NOT_BEHIND:
            continue
        end = at + (2 if raw[at : at + 2] in (b":=", b"=>") else 1)
        if raw[end : end + 1] in (b"=", b":") or raw[end : end + 2] == b"//":
            continue
        left = _LEFT.search(raw, max(0, at - _REACH), at)
        if left is None:
            continue
        place, quoted, bare, names = _SPACE.match(raw, end).end(), [], [], []
        while True:
            string = _STRING.match(raw, place)
            if string:
                quoted.append(string.span(string.lastgroup))
                stop = string.end()
            else:
                word, name = _BARE.match(raw, place), _NAME.match(raw, place)
                if word and not (quoted or names) and not _DOTTED.match(word[0]):
                    bare.append(word.span())
                if name:
                    names.append(_key(name["name"]))
                    stop = name.end()
                else:
                    break
            joined = _JOIN.match(raw, stop)
            if not joined:
                break
            place = joined.end()
        if quoted or bare or names:
            # of "a: b = value" either may be the name, and the other a remark or a type
            for written in (left["name"], left["note"]):
                if written:
                    yield written, quoted, bare, names


# ------------------------------------------------------------------ how sensitive a name is, how secret a literal looks

# words of names and how sensitive they are; a name's worth is that of its most sensitive word or pair of words
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passwort": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.9, "jwt": 0.8, "otp": 0.7,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "account key": 0.9,
    "client secret": 1.0, "auth key": 1.0, "master key": 1.0, "license key": 0.6, "connection string": 0.7,
}
# a name that ends in one of these tells something about a secret
_ABOUT = frozenset("file path url uri name id type length len size count field label hint hash policy expiry expires ttl timeout header prefix suffix regex pattern format".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|_+|0+|1234567890?|change.?me|example|placeholder|dummy|none|null|true|false|undefined|todo|your.*|my.?(?:password|secret|token).*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$\(.*\))\Z")
_SHAPED = re.compile(r"\A(?:[a-z]+://[^@]*|[.~]{0,2}/(?:[\w.-]+/)*[\w.-]*|(?:[\w-]+/)+[\w-]*\.\w{1,5}|[a-z]+(?:[_.-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[A-Z]?[a-z]+)\Z")


def sensitivity(name: str) -> float:
    """0 to 1 for a lower-case name, or one with its words told by case."""
    words = [w.lower() for part in name.split(".")[-2:] for w in _WORDS.findall(part)]
    best = max([_SENSITIVE.get(w, 0.0) for w in words] + [_SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:])], default=0.0)
    return best * 0.3 if best and words[-1] in _ABOUT else best


def strangeness(literal: str) -> float:
    """0 to 1: long, mixed and even in its characters, and none of the usual stand-ins, words, paths or addresses."""
    n = len(literal)
    if n < 8 or any(c.isspace() for c in literal) or _HOLDER.match(literal) or _SHAPED.match(literal):
        return 0.0
    counts = Counter(literal)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = any(c.isdigit() for c in literal) + any(c.islower() for c in literal) + any(c.isupper() for c in literal) + any(not c.isalnum() for c in literal)
    return min(1.0, bits / 3.0) * (1.0 if kinds > 1 else 0.6) * min(1.0, n / 10)


def named_spans(raw: bytes) -> list[tuple[int, int]]:
    """Spans (in bytes) of literals that sensitive names hold."""
    found = list(pairs(raw))
    worth: dict[bytes, float] = {}
    sources: dict[bytes, list[bytes]] = {}
    for written, _, _, names in found:
        key = _key(written)
        worth[key] = max(worth.get(key, 0.0), sensitivity(written.decode("ascii", "replace")))
        sources.setdefault(key, []).extend(names)
    # what a name is worth, the names it is made of are worth as well; highest first, so each is settled once
    settled: set[bytes] = set()
    for start in sorted(worth, key=worth.get, reverse=True):
        level, stack = worth[start], [start]
        while stack:
            name = stack.pop()
            if name not in settled and name in worth:
                settled.add(name)
                worth[name] = max(worth[name], level)
                stack += sources[name]
    out = set()
    for written, quoted, bare, _ in found:
        level = worth[_key(written)]
        if level >= LEAST:
            # a bare word is a name where something assigns to it
            held = quoted + [span for span in bare if _key(raw[slice(*span)]) not in worth]
            out.update(span for span in held if level * strangeness(raw[slice(*span)].decode("utf-8", "replace")) >= LEAST)
    return sorted(out)


def spans_of(raw: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The plain patterns' spans, and all spans, in code points and in order."""
    base = base_spans(raw)
    # spans of one kind don't overlap, so only the last one that begins before a literal can hold it
    by_kind = [([a for a, _, k in base if k == kind], [b for _, b, k in base if k == kind]) for kind in KINDS[:3]]

    def covered(a: int, b: int) -> bool:
        return any((i := bisect_right(low, a)) and high[i - 1] >= b for low, high in by_kind)

    named = [(a, b, "named") for a, b in named_spans(raw) if not covered(a, b)]
    if (base or named) and not raw.isascii():
        # a code point begins at each byte that continues none
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        base, named = ([(int(before[a]), int(before[b]), kind) for a, b, kind in some] for some in (base, named))
    return base, sorted(base + named, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named``."""
    small_batches(docs)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in raw_texts(batch.column(1)):
                base, every = spans_of(raw)
                kinds = Counter(kind for _, _, kind in every)
                digest = hashlib.sha256(shown(base).encode()).hexdigest()
                out.append((*(kinds[k] for k in KINDS[:3]), digest, shown(every), kinds["named"]))
            types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")
