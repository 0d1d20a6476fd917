"""DuckDB statements that compute the registered queries' results independently.

The rules are spelled for RE2. The one rule that needs look-around is applied to
white-space-delimited words instead, which is the same thing: it begins at a word's start and ends before
white space or a character of another kind.
"""

from __future__ import annotations

from cloakwork.plans.derived import CONTACT_TEXT
from cloakwork.sources.rules import REGEX_SCORE, Rule, active_rules

_RE2 = {r"\w": r"\p{L}\p{N}_", r"\u0080-\u" + "FFFF": r"\x{0080}-\x{FFFF}"}
_WORD_RULE = r"^([\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]{2,})(?:$|[^\p{L}\p{N}_.-])"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _re2(rule: Rule) -> str:
    out = rule.regex
    for python, re2 in _RE2.items():
        out = out.replace(python, re2)
    return ("(?i)" if rule.ignore_case else "") + out


def matches_cte(source: str, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in ``cand(key, ord, entity_type, pattern, s, e, v)``: every match of every rule."""
    rules = active_rules(rules)
    plain = [r for r in rules if "(?<=" not in r.regex]
    worded = [r for r in rules if "(?<=" in r.regex]
    # one branch per rule, so that each pattern is a constant and is compiled once
    hits = " UNION ALL ".join(
        f"""SELECT {key}, {r.ord} AS ord, {_quote(r.entity_type)} AS entity_type, {_quote(r.pattern)} AS pattern,
            regexp_extract_all(txt, {_quote(_re2(r))}) AS m, string_split_regex(txt, {_quote(_re2(r))}) AS p
            FROM src WHERE regexp_matches(txt, {_quote(_re2(r))})"""
        for r in plain
    )
    ctes = f"""src AS (SELECT {key}, {text} AS txt FROM {source} WHERE {text} IS NOT NULL),
    hit AS ({hits}),
    piece AS (SELECT {key}, ord, entity_type, pattern, unnest(m) AS v,
                     unnest(p[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM hit),
    plain AS (SELECT {key}, ord, entity_type, pattern, v,
                     sum(length(gap) + length(v)) OVER (PARTITION BY {key}, ord ORDER BY i) AS e FROM piece)"""
    parts = [
        f"SELECT {key}, ord, entity_type, pattern, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM plain"
    ]
    for r in worded:
        ctes += rf""",
    wpart AS (SELECT {key}, unnest(regexp_extract_all(txt, '\S+|\s+')) AS w,
                     generate_subscripts(regexp_extract_all(txt, '\S+|\s+'), 1) AS i
              FROM src WHERE contains(txt, '@')),
    wpos AS (SELECT {key}, w, sum(length(w)) OVER (PARTITION BY {key} ORDER BY i) - length(w) AS s FROM wpart),
    worded AS (SELECT {key}, s, regexp_extract(w, {_quote('(?i)' + _WORD_RULE)}, 1) AS v FROM wpos
               WHERE regexp_matches(w, {_quote('(?i)' + _WORD_RULE)}))"""
        parts.append(
            f"SELECT {key}, {r.ord}, {_quote(r.entity_type)}, {_quote(r.pattern)}, CAST(s AS BIGINT), CAST(s + length(v) AS BIGINT), v FROM worded"
        )
    return ctes + f",\n    cand AS ({' UNION ALL '.join(parts)})"


CONTACTS = f"contacts AS (SELECT c_custkey AS doc_id, {CONTACT_TEXT} AS text FROM customer)"


def kept_cte(key: str = "doc_id", mode: str = "compat") -> str:
    """From ``cand(key, ord, ..., s, e, score)`` to ``kept(key, step, ...)`` by following, from the first
    span, which one wins and where the next undecided one begins."""
    if mode == "longest":
        order = "s, e DESC, ord"
        duel = f"SELECT {key}, rn, rn AS brn, e AS be FROM spans"
    else:
        order = "s, e, ord"
        duel = f"""SELECT a.{key}, a.rn, b.rn AS brn, b.e AS be FROM spans a JOIN spans b
            ON a.{key} = b.{key} AND a.s < b.e AND b.s < a.e
            QUALIFY row_number() OVER (PARTITION BY a.{key}, a.rn ORDER BY b.score DESC, b.rn) = 1"""
    return f"""spans AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM cand),
    duel AS ({duel}),
    hop AS (SELECT d.{key}, d.rn, d.brn, min(n.rn) AS nrn FROM duel d LEFT JOIN spans n
            ON n.{key} = d.{key} AND n.s >= d.be GROUP BY ALL),
    walk({key}, rn, brn, nrn, step) AS (
        SELECT {key}, rn, brn, nrn, 0 FROM hop WHERE rn = 1
        UNION ALL
        SELECT h.{key}, h.rn, h.brn, h.nrn, w.step + 1 FROM walk w JOIN hop h ON h.{key} = w.{key} AND h.rn = w.nrn),
    kept AS (SELECT s.*, w.step FROM walk w JOIN spans s ON s.{key} = w.{key} AND s.rn = w.brn)"""


def masked_cte(key: str = "doc_id", where: str = "true", stand_in: str | None = None) -> str:
    """From ``kept`` and ``src(key, txt)`` to ``toks(key, ord, token, value, ...)`` and ``masked(key,
    masked_text, n_found)``, splicing from the end of the text."""
    token = stand_in or "'{{__OWL:' || entity_type || '_' || n || '__}}'"
    return f"""picked AS (SELECT *, row_number() OVER (PARTITION BY {key}, entity_type ORDER BY s DESC, step) AS n,
                      row_number() OVER (PARTITION BY {key} ORDER BY s DESC, step) - 1 AS place
               FROM kept WHERE {where}),
    toks AS (SELECT {key}, place AS ord, {token} AS token, v AS value, s, e, entity_type, pattern, n FROM picked),
    splice({key}, i, txt) AS (
        SELECT {key}, 0::BIGINT, txt FROM src WHERE {key} IN (SELECT {key} FROM toks)
        UNION ALL
        SELECT t.{key}, t.ord + 1, substr(p.txt, 1, t.s) || t.token || substr(p.txt, t.e + 1)
        FROM splice p JOIN toks t ON t.{key} = p.{key} AND t.ord = p.i),
    done AS (SELECT {key}, txt, i FROM splice QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i DESC) = 1),
    masked AS (SELECT src.{key}, coalesce(done.txt, src.txt) AS masked_text, coalesce(done.i, 0)::BIGINT AS n_found
               FROM src LEFT JOIN done USING ({key}))"""


def replay_cte(replies: str, maps: str) -> str:
    """From ``replies(reply_id, session_id, txt)`` and ``maps(session_id, ord, token, value)``, ord from 0,
    to ``replayed(reply_id, original_text, entities_restored)``."""
    return f"""replay(reply_id, session_id, i, txt, n) AS (
        SELECT reply_id, session_id, 0::BIGINT, txt, 0::BIGINT FROM {replies}
        UNION ALL
        SELECT r.reply_id, r.session_id, r.i + 1, replace(r.txt, m.token, m.value),
               r.n + CASE WHEN contains(r.txt, m.token) THEN 1 ELSE 0 END
        FROM replay r JOIN {maps} m ON m.session_id = r.session_id AND m.ord = r.i),
    replayed AS (SELECT reply_id, txt AS original_text, n AS entities_restored FROM replay
                 QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY i DESC) = 1)"""


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n    ".join(ctes) + f"\n{select}"


def scored(cte: str = "cand") -> str:
    return f"cand AS (SELECT *, {REGEX_SCORE}::DOUBLE AS score FROM {cte})"


def _found(source: str, **kw) -> str:
    """``matches_cte`` with the result scored."""
    return matches_cte(source, **kw).replace("\n    cand AS (", "\n    bare AS (") + ",\n    " + scored("bare")


def mask_oracle(source: str, select: str, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None,
                where: str = "true", stand_in: str | None = None, first: str = "", more: tuple[str, ...] = (), mode: str = "compat") -> str:
    ctes = [c for c in (first, _found(source, rules=rules, key=key, text=text), kept_cte(key, mode), masked_cte(key, where, stand_in), *more) if c]
    return _with(*ctes, select=select)
