"""Detection over a table: rule matches joined by external findings, overlaps resolved.

Everything here is one narrow projection per text unless external findings come as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.columns import settled
from cloakwork.functions.detection import ASCII_GATES, SPAN, with_candidates
from cloakwork.functions.masking import decorated, described
from cloakwork.functions.overlap import kept_places
from cloakwork.functions.regex import SPACE, sql_string
from cloakwork.functions.scan import kept_spans, scannable
from cloakwork.sources.rules import REGEX_SCORE, Rule, active_rules

# External spans rank before every rule, in the order they were given.
_EXTERNAL_BASE = 1_000_000_000
EXTERNAL = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def analyze(
    df: DataFrame,
    text: str = "text",
    rules: list[Rule] | None = None,
    external: str | None = None,
    mode: str = "compat",
    out: str = "found",
    language: str = "en",
) -> DataFrame:
    """Add ``out``, the findings of each text, by descending start.

    ``external`` names an ``array<struct<entity_type,start,end,score>>`` column of further findings, best
    first on ties; spans without text (end <= start) are passed over. Null, empty and blank texts have no
    findings. ``language`` is accepted for all languages: rules do not depend on it.
    """
    rules = active_rules(rules)
    keep = [F.col(f"`{c}`") for c in df.columns]
    if not external and in_one_step(rules):
        return settled(with_kept(df, text, rules, mode, "_kept"), described("_kept", f"`{text}`", labels(rules)), out, ("_kept",))
    df = with_candidates(df, text, rules, "_cand")
    cand = "_cand"
    if external:
        cand = f"""concat(filter(transform(coalesce(`{external}`, cast(array() as {EXTERNAL})),
            (e, i) -> cast(named_struct('start', e.start, 'end', e.end, 'seq', i - {_EXTERNAL_BASE},
                                        'score', e.score) as {SPAN})), e -> e.end > e.start), _cand)"""
        has_text = f"`{text}` rlike {sql_string(f'[^{SPACE}]')}"
        cand = f"if({has_text}, {cand}, cast(array() as array<{SPAN}>))"
    df = settled(df.select(*keep, F.expr(cand).alias("_cand")), "sort_array(_cand)", "_sorted", ("_cand",))
    df = df.select(*keep, "_sorted", kept_places(F.col("_sorted"), mode).alias("_places"))
    df = df.select(*keep, F.expr("transform(_places, p -> _sorted[p.at])").alias("_kept"))
    return settled(df, decorated("_kept", f"`{text}`", labels(rules, external)), out, ("_kept",))


def in_one_step(rules: list[Rule]) -> bool:
    """Whether matching and overlaps can be settled in one step, by ``with_kept``."""
    return bool(rules) and all(scannable(r.regex, r.ignore_case) for r in rules)


def with_kept(df: DataFrame, text: str, rules: list[Rule], mode: str, out: str) -> DataFrame:
    """Add ``out``, the spans that ``kept_spans`` keeps, computed once."""
    known = [(r.ord, r.entity_type, r.regex, r.ignore_case, ASCII_GATES[r.gate]) for r in rules]
    return settled(df, kept_spans(F.col(f"`{text}`"), known, REGEX_SCORE, mode), out)


def labels(rules: list[Rule], external: str | None = None, span: str = "k") -> str:
    """SQL giving entity type and pattern of a span."""
    by_ord = {r.ord: r for r in rules}
    shape = "struct<entity_type:string,pattern:string>"
    table = ", ".join(
        f"named_struct('entity_type', {sql_string(by_ord[i].entity_type)}, 'pattern', {sql_string(by_ord[i].pattern)})"
        if i in by_ord
        else "named_struct('entity_type', '', 'pattern', '')"
        for i in range(max(by_ord, default=0) + 1)
    )
    ruled = f"cast(array({table})[{span}.seq] as {shape})"
    if not external:
        return ruled
    given = f"cast(named_struct('entity_type', `{external}`[{span}.seq + {_EXTERNAL_BASE}].entity_type, 'pattern', null) as {shape})"
    return f"if({span}.seq < 0, {given}, {ruled})"


def of_types(found: str, types: list[str] | None = None, types_column: str | None = None, kind: str = "f.entity_type") -> str:
    """SQL keeping findings of the wanted types; no list or an empty list means all. ``kind`` is the type of ``f``."""
    if types_column:
        return (
            f"filter({found}, f -> coalesce(size(`{types_column}`), 0) <= 0 "
            f"or array_contains(`{types_column}`, {kind}))"
        )
    if types:
        return f"filter({found}, f -> {kind} in ({', '.join(sql_string(t) for t in types)}))"
    return found


def finding_rows(df: DataFrame, key: str, found: str = "found") -> DataFrame:
    """One row per finding. ``explode_outer`` first, so the findings are not computed twice for a
    pushed-down emptiness test."""
    return (
        df.select(key, F.explode_outer(found).alias("f"))
        .select(key, "f.*")
        .filter(F.col("start").isNotNull())
    )
