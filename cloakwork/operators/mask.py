"""Reversible masking of a table and the rows of its token map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.columns import settled
from cloakwork.functions.masking import STRATEGIES, described, numbered, spliced, token_pairs
from cloakwork.functions.tokens import token
from cloakwork.operators.analyze import analyze, in_one_step, labels, of_types, with_kept
from cloakwork.sources.rules import Rule, active_rules


def mask_table(
    df: DataFrame,
    text: str = "text",
    session: str | None = None,
    entities_to_mask: list[str] | None = None,
    entities_column: str | None = None,
    rules: list[Rule] | None = None,
    external: str | None = None,
    mode: str = "compat",
    strategy: str = "REPLACE",
    salt: str = "",
) -> DataFrame:
    """Replace the findings of each text by tokens.

    Adds ``masked_text``, ``entities_found`` (by descending start), ``token_map`` (tokens and values in
    numbering order; empty for irreversible strategies) and ``session_id``: the ``session`` column as text,
    or a random id where it is null or none is named. Prefer a column: random ids change on recomputation.

    Types are chosen after overlaps are resolved, by ``entities_to_mask`` or per row by
    ``entities_column``; an empty choice means all.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    keep = [F.col(f"`{c}`") for c in df.columns if c != "session_id"]
    sid = F.expr("uuid()")
    if session:
        sid = F.coalesce(F.col(session).cast("string"), F.expr("uuid()"))
    known = active_rules(rules)
    if strategy == "REPLACE" and not external and in_one_step(known):
        # numbers follow from the spans, so a text's findings are only described where they are asked for
        kind = f"{labels(known, span='f')}.entity_type"
        out = with_kept(df, text, known, mode, "_kept")
        if entities_to_mask or entities_column:
            out = settled(out, of_types("_kept", entities_to_mask, entities_column, kind), "_chosen", ("_kept",))
        found = out.columns[-1]
        return out.select(
            *keep,
            F.expr(spliced(found, f"`{text}`", token(kind, "f.n"))).alias("masked_text"),
            F.expr(
                f"""transform({described(found, f"`{text}`", labels(known))}, f -> named_struct('entity_type', f.entity_type, 'start', f.start,
                    'end', f.end, 'score', f.score, 'text', f.text, 'pattern', f.pattern))"""
            ).alias("entities_found"),
            F.expr(token_pairs(found, f"`{text}`", kind)).alias("token_map"),
            sid.alias("session_id"),
        )
    out = analyze(df, text, rules, external, mode, "_found")
    out = out.select("*", F.expr(of_types("_found", entities_to_mask, entities_column)).alias("_chosen"))
    out = settled(out, numbered("_chosen", strategy, salt), "_num", ("_found", "_chosen"))
    pairs = "transform(_num, f -> named_struct('token', f.token, 'value', f.text))"
    if strategy == "TOKENIZE":
        pairs = f"array_distinct({pairs})"
    if strategy not in ("REPLACE", "TOKENIZE"):
        pairs = "cast(array() as array<struct<token:string,value:string>>)"
    return out.select(
        *keep,
        F.expr(spliced("_num", f"`{text}`")).alias("masked_text"),
        F.expr(
            """transform(_num, f -> named_struct('entity_type', f.entity_type, 'start', f.start, 'end', f.end,
                'score', f.score, 'text', f.text, 'pattern', f.pattern))"""
        ).alias("entities_found"),
        F.expr(pairs).alias("token_map"),
        sid.alias("session_id"),
    )


def token_rows(masked: DataFrame, *keys: str) -> DataFrame:
    """The token maps in long form: ``keys, ord, token, value``; ``ord`` counts from 0 within a map."""
    return (
        masked.select(*keys, F.posexplode_outer("token_map").alias("ord", "p"))
        .select(*keys, "ord", "p.token", "p.value")
        .filter(F.col("token").isNotNull())
    )
