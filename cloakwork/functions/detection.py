"""Rule matching as one narrow projection: text in, array of candidate spans out, no shuffle.

Texts of ASCII characters go through ``scan``, batch by batch, with all rules that it can take, and other texts with those of them
that see only kinds of other characters. Rules and texts that are left take three steps per text, all built-in expressions:

1. *Digests*: a few shortened copies of the text that keep everything a family of rules can match
   (digits with their surroundings; long words). Most texts shrink to almost nothing.
2. *Hits*: for each rule, does it match? Tested on the digest of its family, so 90 rules cost little.
3. *Offsets*: only rules that hit are run over the whole text, once, to get every match and its position.

Digests only decide whether a rule runs; positions always come from the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.regex import ASCII_DIGIT, ASCII_WORD, DIGIT, has_marks, has_match, marked, match_offsets, sql_string, to_java
from cloakwork.functions.scan import OTHER_DIGIT, foldable, match_spans, to_re2
from cloakwork.sources.rules import REGEX_SCORE, Rule

SPAN = "struct<start:int,end:int,seq:int,score:double>"
EMPTY_SPANS = f"cast(array() as array<{SPAN}>)"

_NOT_DIGIT = r"\P{Nd}"
# A digit rule never holds more than three non-digits in a row and looks at most four characters beyond
# its first and last digit, so the inside of a longer stretch without digits can be cut out.
_CUT_DIGITS = f"({_NOT_DIGIT}{{4}}){_NOT_DIGIT}+({_NOT_DIGIT}{{4}})"
# In a text of ASCII characters a number rule matches whole words of digits only: other words shrink to one letter, which keeps
# the boundaries around them, and the inside of longer stretches of those is cut out as well.
_CUT_PLAIN = f"([^{ASCII_DIGIT}]{{4}})[^{ASCII_DIGIT}]+([^{ASCII_DIGIT}]{{4}})"
_OTHER_WORD = rf"\b[{ASCII_DIGIT}]*+[{ASCII_WORD[len(ASCII_DIGIT):]}][{ASCII_WORD}]*+"
_FOUR_DIGITS = f"{DIGIT}(?:{_NOT_DIGIT}{{0,3}}{DIGIT}){{3}}"
_SIX_DIGITS = f"{DIGIT}(?:{_NOT_DIGIT}{{0,3}}{DIGIT}){{5}}"
# A long-word rule holds no white space and at least 20 of these characters in a row. The test is tried
# only where such a run begins; the words are cut out only of texts that pass it.
_WORD_CHAR = "[0-9A-Za-z/+=_-]"
_HAS_LONG_WORD = to_java(f"(?<!{_WORD_CHAR}){_WORD_CHAR}{{20}}")
_LONG_WORDS = to_java(rf"(?<!\S)(?=\S{{20}})\S*{_WORD_CHAR}{{20}}\S*")
# Both begin at a separator, which is rarer in prose than the hex letters around it.
_HEX_COLON = to_java(":(?:[0-9a-fA-F]{1,4})?:")
_HEX_PAIR = to_java(r"[:-][0-9A-Fa-f]{2}[:-]|\.[0-9A-Fa-f]{4}\.")
_IBAN_HEAD = to_java(r"[A-Z]{2}\d{2}")

# gate -> (expression that must hold, column the rule is tested on)
GATES = {
    "at": ("{p}at", "{text}"),
    "quote": ("{p}quote", "{text}"),
    "digits4": ("{p}d4", "{p}digits"),
    "digits6": ("{p}d6", "{p}digits"),
    "numbers4": ("{p}n4", "{p}numbers"),
    "numbers6": ("{p}n6", "{p}numbers"),
    "longword": ("{p}words <> ''", "{p}words"),
    "jwt": ("{p}jwt", "{text}"),
    "hexcolon": ("{p}hexcolon", "{text}"),
    "hexpair": ("{p}hexpair", "{text}"),
    "iban": ("{p}iban", "{text}"),
    None: ("true", "{text}"),
}
_ASCII_FOUR, _ASCII_SIX = (f"[0-9](?:[^0-9]{{0,3}}[0-9]){{{n}}}" for n in (3, 5))
# gate -> what must match in a text of ASCII characters
ASCII_GATES = {
    "at": "@",
    "quote": "\"|'@",
    "digits4": _ASCII_FOUR,
    "digits6": _ASCII_SIX,
    "numbers4": _ASCII_FOUR,
    "numbers6": _ASCII_SIX,
    "longword": f"{_WORD_CHAR}{{20}}",
    "jwt": "eyJ",
    "hexcolon": ":(?:[0-9a-fA-F]{1,4})?:",
    "hexpair": r"[:-][0-9A-Fa-f]{2}[:-]|\.[0-9A-Fa-f]{4}\.",
    "iban": "[A-Z]{2}[0-9]{2}",
    None: None,
}


def _digests(text: str, p: str) -> list[dict[str, str]]:
    """SQL of the digests by name, in steps that each may use the ones before."""
    plain, cut = sql_string(_CUT_PLAIN), sql_string(_CUT_DIGITS)
    first = {
        f"{p}marks": has_marks(text),
        f"{p}ascii": f"length({text}) = octet_length({text})",
        f"{p}at": f"contains({text}, '@')",
        f"{p}quote": f"""contains({text}, '"') or contains({text}, "'@")""",
        f"{p}jwt": f"contains({text}, 'eyJ')",
        f"{p}words": f"if({text} rlike {sql_string(_HAS_LONG_WORD)}, "
        f"array_join(regexp_extract_all({text}, {sql_string(_LONG_WORDS)}, 0), ' '), '')",
        f"{p}hexcolon": f"contains({text}, ':') and {text} rlike {sql_string(_HEX_COLON)}",
        f"{p}hexpair": f"{text} rlike {sql_string(_HEX_PAIR)}",
    }
    second = {f"{p}digits": f"if({p}ascii, regexp_replace({text}, {plain}, '$1$2'), regexp_replace({text}, {cut}, '$1$2'))"}
    third = {
        f"{p}d4": f"{p}digits rlike {sql_string(_FOUR_DIGITS)}",
        f"{p}d6": f"{p}digits rlike {sql_string(_SIX_DIGITS)}",
        f"{p}iban": f"{p}digits rlike {sql_string(_IBAN_HEAD)}",
        f"{p}numbers": f"if({p}ascii, regexp_replace(regexp_replace({p}digits, {sql_string(_OTHER_WORD)}, 'x'), {plain}, '$1$2'), {p}digits)",
    }
    fourth = {
        f"{p}n4": f"{p}numbers rlike {sql_string(_FOUR_DIGITS)}",
        f"{p}n6": f"{p}numbers rlike {sql_string(_SIX_DIGITS)}",
    }
    return [first, second, third, fourth]


def with_candidates(df: DataFrame, text: str, rules: list[Rule], out: str, gated: bool = True) -> DataFrame:
    """Add ``out``: every match of every rule in column ``text`` (null or blank text: none)."""
    if not rules:
        return df.withColumn(out, F.expr(EMPTY_SPANS))
    keep = [F.col(f"`{c}`") for c in df.columns]
    text_sql = f"`{text}`"
    scanned = [(r, to_re2(r.regex, r.ignore_case), foldable(r.regex, r.ignore_case)) for r in rules]
    quick = [(r.ord, regex, ASCII_GATES[r.gate if gated else None], fold) for r, regex, fold in scanned if regex]
    others = [r for r, regex, _ in scanned if not regex]
    plain = f"(length({text_sql}) = octet_length({text_sql}) and not ({has_marks(text_sql)}))"
    odd = f"(not {plain} and {text_sql} rlike {sql_string(OTHER_DIGIT)})"
    df = df.select(
        *keep,
        F.expr(f"if({odd}, null, {text_sql})").alias("_even"),
        F.expr(f"if({plain}, null, {text_sql})").alias("_uneven"),
        F.expr(f"if({odd}, {text_sql}, null)").alias("_odd"),
    )
    parts = []
    if quick:
        df = df.select("*", match_spans(F.col("_even"), quick, REGEX_SCORE).alias("_quick"))
        parts.append("_quick")
        for column, fold in (("_uneven", False), ("_odd", True)):
            some = [r for r, regex, folds in scanned if regex and folds == fold]
            if some:
                df, spans = _with_spans(df, column, f"_digest{column}_", some, gated)
                parts.append(f"if({column} is null, {EMPTY_SPANS}, {spans})")
    if others:
        df, spans = _with_spans(df, text_sql, "_whole_", others, gated)
        parts.append(spans)
    return df.select(*keep, F.expr(f"concat({', '.join(parts)})").alias(out))


def _with_spans(df: DataFrame, text_sql: str, p: str, rules: list[Rule], gated: bool) -> tuple[DataFrame, str]:
    """``df`` with digests of a text, named after ``p``, and SQL for every match of the rules."""
    # digests that no rule asks for are pruned away
    for step in _digests(text_sql, p):
        df = df.select("*", *[F.expr(sql).alias(name) for name, sql in step.items()])
    hits = []
    for i, rule in enumerate(rules):
        gate, column = GATES[rule.gate if gated else None]
        gate, column = gate.format(p=p, text=text_sql), column.format(p=p, text=text_sql)
        regex = sql_string(to_java(rule.regex, rule.ignore_case))
        plain = sql_string(to_java(rule.regex, rule.ignore_case, ascii_only=True))
        # a rule that has no digest is not tried first: marking its matches tells as much
        test = f"if({p}ascii, {column} rlike {plain}, {column} rlike {regex})" if column != text_sql else f"(not {p}marks or {text_sql} rlike {regex})"
        hits.append(
            f"if({gate} and {test}, named_struct('i', {i}, 'ord', {rule.ord}, "
            f"'cut', {marked(text_sql, regex, plain, f'{p}marks', f'{p}ascii')}), null)"
        )
    table = ", ".join(sql_string(to_java(r.regex, r.ignore_case)) for r in rules)
    offsets = match_offsets(text_sql, "r.cut", f"array({table})[r.i]", "r.ord", REGEX_SCORE)
    return df, f"flatten(transform(filter(array({', '.join(hits)}), h -> h is not null and ({has_match(text_sql, 'h.cut')})), r -> {offsets}))"
