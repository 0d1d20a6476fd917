"""A second, plain-Python reading of the rules, used only to compare results with."""

import re
from collections import Counter

from cloakwork.sources.rules import REGEX_SCORE, active_rules


def candidates(text, rules=None, external=()):
    spans = [(s, e, score, kind, None) for kind, s, e, score in external if e > s]
    for rule in active_rules(rules):
        for m in re.finditer(rule.regex, text, re.IGNORECASE if rule.ignore_case else 0):
            spans.append((m.start(), m.end(), REGEX_SCORE, rule.entity_type, rule.pattern))
    return spans


def keep(spans):
    """Follow the chain: from a span to the winner among all that overlap it, and on to the first span that begins at the
    winner's end or later."""
    ranked = sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][1], i))
    place = {i: p for p, i in enumerate(ranked)}

    def overlapping(i):
        return (j for j in range(len(spans)) if spans[j][0] < spans[i][1] and spans[i][0] < spans[j][1])

    winner = {i: min(overlapping(i), key=lambda j: (-spans[j][2], place[j])) for i in ranked}
    chain, todo = [], ranked
    while todo:
        best = winner[todo[0]]
        chain.append(best)
        todo = [i for i in todo[1:] if spans[i][0] >= spans[best][1]]
    return [spans[i] for i in dict.fromkeys(chain)]


def mask(text, types=None, rules=None, external=()):
    """(masked text, [(token, value)])"""
    if not text or not text.strip():
        return text, []
    found = [s for s in keep(candidates(text, rules, external)) if not types or s[3] in types]
    found = [s for _, _, s in sorted((-s[0], n, s) for n, s in enumerate(found))]
    behind, pairs = Counter(), []
    for start, end, _, kind, _ in found:
        behind.update([kind])
        pairs.append(("{{__OWL:%s_%d__}}" % (kind, behind[kind]), text[start:end]))
    for (start, end, *_), (token, _) in zip(found, pairs):
        # offsets are those of the original text; only what lies before them is unchanged
        text = "".join((text[:start], token, text[end:]))
    return text, pairs
