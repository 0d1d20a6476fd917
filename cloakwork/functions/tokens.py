"""Placeholder tokens: making, finding and putting back."""

from __future__ import annotations

# The token format that masked text carries.
TOKEN_PREFIX = "{{__OWL:"
TOKEN_SUFFIX = "__}}"
TOKEN_REGEX = r"\{\{__OWL:[A-Z_]+_\d+__\}\}"
TOKEN_TYPE_REGEX = r"\{\{__OWL:([A-Z_]+)_\d+__\}\}"
# End of fixed values.

# In Java's engine ``\d`` is ASCII unless asked otherwise.
TOKEN_JAVA = TOKEN_REGEX.replace(r"\d", r"\p{Nd}")
TOKEN_TYPE_JAVA = TOKEN_TYPE_REGEX.replace(r"\d", r"\p{Nd}")
PAIRS = "array<struct<token:string,value:string>>"


def token(entity_type: str, number: str) -> str:
    """SQL for the token of the ``number``-th finding of ``entity_type``."""
    return f"concat('{TOKEN_PREFIX}', {entity_type}, '_', {number}, '{TOKEN_SUFFIX}')"


def restore(text: str, pairs: str) -> str:
    """SQL putting values back: in the order of ``pairs``, replace every occurrence of each token.

    Gives ``struct<text, restored>``; a token that occurs several times counts once. The order matters
    only where a restored value itself holds a later token.
    """
    return f"""aggregate(coalesce({pairs}, cast(array() as {PAIRS})),
        named_struct('text', {text}, 'restored', 0),
        (acc, p) -> if(contains(acc.text, p.token),
            named_struct('text', replace(acc.text, p.token, p.value), 'restored', acc.restored + 1), acc))"""
