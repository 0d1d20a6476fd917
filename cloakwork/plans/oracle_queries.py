"""The DuckDB statement for each registered query."""

from __future__ import annotations

import hmac

from cloakwork.plans import oracles as o
from cloakwork.plans.derived import AS_OF, CONTACT_LENGTHS, CONTACT_TRUTH, EVENT_TOKENS, EVENT_TTL, FAKE_VALUES, FINDINGS, MODEL_LABELS, OP_OF_EVENT
from cloakwork.plans.queries import DELAY_MINUTES, DEMO_KEYS, DETECTORS, GHOST, URL_RULE
from cloakwork.operators.crypto import INFO, validate_key
from cloakwork.operators.flow import FLOW_ERROR
from cloakwork.functions.masking import SYNTHETIC_OTHER, SYNTHETIC_VALUES
from cloakwork.sources.labels import LABEL_TYPES
from cloakwork.sources.rules import Rule, active_rules, default_rules, extend_rules, without_rules

ORACLES: dict[str, str] = {}


def _sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n    ".join(c for c in ctes if c) + f"\n{select}"


def _mask(source: str, select: str, **kw) -> str:
    if source == "contacts":
        kw.setdefault("first", o.CONTACTS)
    if source == "pages":
        kw.update(key="page_id", text="html")
    return o.mask_oracle(source, select, **kw)


def _spans(source: str, select: str, rules: list[Rule] | None = None, first: str = "") -> str:
    if source == "contacts":
        first = o.CONTACTS
    kw = {"key": "page_id", "text": "html"} if source == "pages" else {}
    return _sql(first, o.matches_cte(source, rules=rules, **kw), select=select)


_SPAN = "s AS span_start, e AS span_end"

# ------------------------------------------------------------------ sources and sinks

ORACLES["a1_text_source"] = " UNION ALL ".join(
    f"SELECT '{t}' AS source_table, count({c}) AS n_texts, CAST(sum(length({c})) AS BIGINT) AS n_chars, "
    f"count(*) FILTER (WHERE trim({c}) = '') AS n_blank FROM {t}"
    for t, c in (("documents", "text"), ("pages", "html"), ("benchmark", "text"), ("conversations", "text"))
)
ORACLES["a2_masked_sink"] = _mask(
    "documents",
    """SELECT d.doc_id, d.lang, d.source, d.n_chars, m.masked_text, m.n_found AS entities_found,
       CAST(d.doc_id AS VARCHAR) AS session_id FROM documents d JOIN masked m USING (doc_id)""",
)
ORACLES["a3_vault_sink"] = _mask(
    "contacts", "SELECT CAST(doc_id AS VARCHAR) AS session_id, ord, token, value FROM toks WHERE doc_id % 7 <> 0"
)
_all_rules = ", ".join(f"({r.ord}::BIGINT, '{r.entity_type}', '{r.pattern}', {str(r.enabled).lower()})" for r in default_rules())
ORACLES["a4_rule_source"] = _spans(
    "documents",
    f"""SELECT r.ord, r.entity_type, r.pattern, r.enabled, count(c.ord) AS n_matches
       FROM (VALUES {_all_rules}) r(ord, entity_type, pattern, enabled) LEFT JOIN cand c ON c.ord = r.ord GROUP BY ALL""",
)
_labels = ", ".join(f"'{x}'" for x in MODEL_LABELS)
_types = ", ".join(f"('{a}', '{b}')" for a, b in LABEL_TYPES.items())
_MODEL = "model AS (" + " UNION ALL ".join(
    f"""SELECT c_custkey AS doc_id, {rank} AS rank, [{_labels}][(c_custkey + {shift}) % {len(MODEL_LABELS)} + 1] AS label,
        CAST({start} AS BIGINT) AS s, CAST({start} + {length} AS BIGINT) AS e, CAST({score} AS DOUBLE) AS score FROM customer"""
    for rank, (start, length, score, shift) in enumerate(FINDINGS)
) + f""" ),
    types(label, entity_type) AS (VALUES {_types}),
    typed AS (SELECT m.*, coalesce(t.entity_type, upper(replace(m.label, ' ', '_'))) AS entity_type
              FROM model m LEFT JOIN types t USING (label))"""
ORACLES["a5_external_spans"] = _sql(
    o.CONTACTS, o.matches_cte("contacts"), _MODEL,
    select=f"""SELECT doc_id, entity_type, pattern, {_SPAN}, 0.95::DOUBLE AS score FROM cand
        UNION ALL SELECT doc_id, entity_type, NULL, s, e, score FROM typed""",
)
ORACLES["a6_audit_sink"] = _mask(
    "documents",
    """SELECT 'mask' AS event_type, CAST(doc_id AS VARCHAR) AS session_id, count(*) AS token_count,
       string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS token_types FROM toks GROUP BY doc_id""",
)
ORACLES["a7_stream_source"] = "SELECT conv_id, turn, role, text FROM conversations"

# ------------------------------------------------------------------ detection

_B1 = "SELECT {key}, CAST(ord AS BIGINT) AS ord, entity_type, pattern, " + _SPAN + ", v AS value FROM cand"
ORACLES["b1_regex_detect"] = _spans("documents", _B1.format(key="doc_id"))
ORACLES["b1_regex_detect_pages"] = _spans("pages", _B1.format(key="page_id"))
ORACLES["b1_regex_detect_contacts"] = _spans("contacts", _B1.format(key="doc_id"))
ORACLES["b10_distinct_texts"] = ORACLES["b1_regex_detect"]
ORACLES["b2_model_detect"] = _spans(
    "documents",
    """SELECT doc_id, 'person' AS label, 'PERSON' AS entity_type, 0.75::DOUBLE AS score, s AS span_start,
       e - 1 AS span_end FROM cand""",
    rules=[Rule(0, "PERSON", "stub", r"[a-z]+\.[0-9]+@")],
)
ORACLES["b3_label_map"] = _sql(
    _MODEL, select="SELECT label, entity_type, count(*) AS n_spans FROM typed GROUP BY ALL"
)
ORACLES["b4_threshold"] = _sql(
    _MODEL, select=f"SELECT doc_id, label, score, {_SPAN} FROM typed WHERE score >= 0.5"
)
_BOTH = f"""bare AS (SELECT doc_id, ord, entity_type, pattern, s, e, v FROM cand0),
    cand AS (SELECT doc_id, ord, entity_type, pattern, s, e, v, 0.95::DOUBLE AS score FROM bare
             UNION ALL
             SELECT t.doc_id, t.rank - 10, t.entity_type, NULL, t.s, t.e, substr(c.text, t.s + 1, t.e - t.s), t.score
             FROM typed t JOIN contacts c USING (doc_id) WHERE t.score >= 0.5)"""
_WITH_MODEL = (o.CONTACTS, o.matches_cte("contacts").replace("\n    cand AS (", "\n    cand0 AS ("), _MODEL, _BOTH, o.kept_cte())
ORACLES["b5_analyze"] = _sql(
    *_WITH_MODEL,
    select=f"""SELECT doc_id, CAST(step AS BIGINT) AS pos, entity_type, pattern, score, {_SPAN}, v AS value FROM kept""",
)
for _name, _kind in DETECTORS.items():
    _rules = active_rules(entity_types=[_kind])
    _docs = o.matches_cte("documents", rules=_rules)
    ORACLES[_name] = f"""SELECT 'documents' AS origin, doc_id, pattern, {_SPAN}, v AS value FROM ({_spans("documents", "SELECT * FROM cand", _rules)})
        UNION ALL
        SELECT 'contacts', doc_id, pattern, s, e, v FROM ({_spans("contacts", "SELECT * FROM cand", _rules)})"""
ORACLES["b8_rule_extension"] = _spans(
    "pages",
    _B1.format(key="page_id"),
    rules=extend_rules(without_rules(default_rules(), [("EMAIL_ADDRESS", "quoted")]), [URL_RULE]),
)
ORACLES["b9_luhn"] = _spans(
    "contacts",
    f"""SELECT doc_id, pattern, {_SPAN}, v AS value FROM cand WHERE (
        SELECT sum(CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END END) % 10 = 0 FROM (
            SELECT unnest(range(1, length(w) + 1)) AS i,
                   CAST(unnest(string_split(reverse(w), '')) AS INTEGER) AS d
            FROM (SELECT regexp_replace(v, '[^0-9]', '', 'g') AS w)))""",
    rules=active_rules(entity_types=["CREDIT_CARD"]),
)
ORACLES["b10_cached_runs"] = ORACLES["b10_distinct_texts"]
_FRESH = "SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE doc_id % 10 <> 0"
ORACLES["b10_cache_use"] = f"""SELECT '1' AS run, count(*) AS n_matched FROM ({_FRESH})
    UNION ALL SELECT '2', count(DISTINCT coalesce(text, '')) FROM documents WHERE coalesce(text, '') NOT IN ({_FRESH}) UNION ALL SELECT '3', 0"""

# ------------------------------------------------------------------ spans

ORACLES["c1_filter_types"] = _mask(
    "contacts", "SELECT doc_id, masked_text, n_found FROM masked", where="entity_type IN ('EMAIL_ADDRESS', 'IBAN_CODE')"
)
_KEPT = f"SELECT doc_id, entity_type, pattern, {_SPAN}, v AS value FROM kept"
ORACLES["c2_resolve_overlaps"] = _mask("contacts", _KEPT)
ORACLES["c2_resolve_longest"] = _mask("contacts", _KEPT, mode="longest")
ORACLES["c2_resolve_documents"] = _mask(
    "documents", f"SELECT doc_id, CAST(step AS BIGINT) AS pos, entity_type, pattern, {_SPAN}, v AS value FROM kept"
)
ORACLES["c3_islands"] = _spans(
    "contacts",
    """SELECT doc_id, CAST(island AS BIGINT) AS island, min(s) AS island_start, max(e) AS island_end, count(*) AS n_spans
       FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END)
                       OVER (PARTITION BY doc_id ORDER BY s, e, ord) AS island
             FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, ord
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cand))
       GROUP BY ALL""",
)
ORACLES["c4_order_spans"] = _mask(
    "contacts", f"SELECT doc_id, ord AS place, entity_type, {_SPAN}, value FROM toks"
)
ORACLES["c5_span_count"] = _mask("documents", "SELECT doc_id, n_found AS entities_found FROM masked")
ORACLES["c6_overlap_counts"] = _spans(
    "contacts",
    f"""SELECT a.doc_id, CAST(a.ord AS BIGINT) AS seq, count(*) AS overlaps, a.s AS span_start, a.e AS span_end
       FROM cand a JOIN cand b ON a.doc_id = b.doc_id AND ((b.s <= a.s AND a.s < b.e) OR (a.s <= b.s AND b.s < a.e))
       GROUP BY ALL""",
)
ORACLES["c6_agreement"] = _sql(
    o.CONTACTS, o.matches_cte("contacts"), _MODEL,
    """pairs AS (SELECT t.doc_id, t.rank, t.label, t.entity_type = c.entity_type AS same, t.s = c.s AND t.e = c.e AS exact, c.entity_type AS rule_type, c.pattern, c.ord, c.s AS cs
        FROM typed t JOIN cand c ON c.doc_id = t.doc_id AND ((t.s <= c.s AND c.s < t.e) OR (c.s <= t.s AND t.s < c.e)))""",
    """every AS (SELECT label, rule_type, pattern, same, exact FROM pairs
        UNION ALL SELECT label, NULL, NULL, NULL, NULL FROM typed ANTI JOIN pairs USING (doc_id, rank)
        UNION ALL SELECT NULL, entity_type, pattern, NULL, NULL FROM cand c ANTI JOIN pairs p ON p.doc_id = c.doc_id AND p.ord = c.ord AND p.cs = c.s)""",
    select="""SELECT label, rule_type, pattern, count(*) AS n_rows, count(*) FILTER (WHERE same) AS n_agree,
        count(*) FILTER (WHERE NOT same) AS n_conflict, count(*) FILTER (WHERE exact) AS n_exact FROM every GROUP BY ALL""",
)

# ------------------------------------------------------------------ masking

_TEXT = "SELECT doc_id, masked_text FROM masked"
_COUNTED = "SELECT doc_id, masked_text, n_found AS n_entities FROM masked"
ORACLES["d1_make_token"] = _mask("documents", "SELECT token, count(*) AS n_texts FROM toks GROUP BY token")
ORACLES["d2_number_tokens"] = _mask("contacts", f"SELECT doc_id, entity_type, n, {_SPAN}, value FROM toks")
ORACLES["d3_mask"] = _mask("contacts", _TEXT)
ORACLES["d3_mask_pages"] = _mask("pages", "SELECT page_id, masked_text FROM masked")
ORACLES["d4_token_map"] = _mask("documents", "SELECT doc_id, ord, token, value FROM toks")
ORACLES["d5_session_key"] = """SELECT role, count(*) FILTER (WHERE role <> 'user') AS n_generated,
    count(*) FILTER (WHERE role = 'user') AS n_given FROM conversations GROUP BY role"""
ORACLES["d6_mask_table"] = _mask("documents", _COUNTED)
ORACLES["d6_mask_with_model"] = _sql(*_WITH_MODEL, o.masked_cte(), select=_COUNTED)
ORACLES["d6_mask_training_texts"] = _mask(
    "documents", _TEXT + " WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"
)
_SHA = "sha256({0})"
_WHOLE = " || ".join(
    f"lpad(CAST(CAST(('0x' || substr(sha256({{0}}), {1 + 15 * i}, {n})) AS BIGINT) AS VARCHAR), {d}, '0')"
    for i, (n, d) in enumerate([(15, 19)] * 4 + [(4, 5)])
)
_NUMBER = "CAST(('0x' || substr(sha256({0}), 1, 15)) AS BIGINT)"


def _pick(values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][{_NUMBER.format('v')} % {len(values)} + 1]"


ORACLES["d7_redact"] = _mask("documents", _TEXT, stand_in="'[REDACTED]'")
ORACLES["d8_truncate"] = _mask(
    "documents",
    _TEXT,
    stand_in="""CASE WHEN entity_type = 'EMAIL_ADDRESS' AND contains(v, '@')
        THEN regexp_replace(v, '@.*\\.', '@***.') ELSE '***' || right(v, 4) END""",
)
ORACLES["d9_hash"] = _mask("documents", _TEXT, stand_in=_SHA.format("v"))
ORACLES["d10_tokenize"] = _mask(
    "documents",
    "SELECT token, value, count(DISTINCT doc_id) AS n_texts FROM toks GROUP BY ALL",
    stand_in="'{{__OWL:' || entity_type || '_' || " + _WHOLE.format("entity_type || ':' || v") + " || '__}}'",
)
ORACLES["d11_synthetic"] = _mask(
    "documents",
    _TEXT,
    stand_in="CASE entity_type "
    + " ".join(f"WHEN '{t}' THEN {_pick(v)}" for t, v in SYNTHETIC_VALUES.items())
    + f" ELSE {_pick(SYNTHETIC_OTHER)} END",
)

_FAKES = "fakes AS (SELECT entity_type, fake_value, row_number() OVER (PARTITION BY entity_type ORDER BY substr(md5(fake_value), 1, 3), fake_value) - 1 AS number, " \
    "count(*) OVER (PARTITION BY entity_type) AS n FROM (" + " UNION ".join(f"SELECT '{t}' AS entity_type, {v} AS fake_value FROM customer" for t, v in FAKE_VALUES.items()) + "))"
_FAKED = "CASE " + " ".join(
    f"WHEN entity_type = '{t}' THEN (SELECT fake_value FROM fakes x WHERE x.entity_type = '{t}' AND x.number = {_NUMBER.format('v')} % x.n)" for t in FAKE_VALUES
) + " " + " ".join(f"WHEN entity_type = '{t}' THEN {_pick(v)}" for t, v in SYNTHETIC_VALUES.items()) + f" ELSE {_pick(SYNTHETIC_OTHER)} END"
ORACLES["d11_fake_values"] = " UNION ALL ".join(
    f"SELECT * FROM ({_mask(source, f'SELECT {chr(39)}{source}{chr(39)} AS origin, doc_id, masked_text FROM masked', stand_in=_FAKED, first=_FAKES + (', ' + o.CONTACTS if source == 'contacts' else ''))})"
    for source in ("documents", "contacts")
)

# ------------------------------------------------------------------ restoring

_REPLIES = f"replies AS (SELECT doc_id AS reply_id, doc_id AS session_id, masked_text || '{GHOST}' AS txt FROM masked)"
_RESTORED = "SELECT * FROM replayed"


def _restored(maps: str) -> str:
    return _mask("documents", _RESTORED, more=(_REPLIES, f"maps AS ({maps})", o.replay_cte("replies", "maps")))


ORACLES["e1_demask"] = _restored("SELECT doc_id AS session_id, ord, token, value FROM toks")
ORACLES["e2_demask_session"] = _restored("SELECT doc_id AS session_id, ord, token, value FROM toks WHERE doc_id % 3 <> 0")
ORACLES["e4_demask_precedence"] = _restored(
    """SELECT doc_id AS session_id, ord, token, CASE WHEN doc_id % 2 = 0 THEN '#' || value ELSE value END AS value
       FROM toks"""
)
_ASKED = f"""SELECT doc_id AS request_id, CAST(doc_id AS VARCHAR) AS session_id, token, value FROM toks
    UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), '{GHOST.strip()}', '{GHOST.strip()}' FROM toks WHERE ord = 0"""
_LOST = f"""SELECT -doc_id - 1, 'x' || doc_id, token, token FROM toks
    UNION ALL SELECT -doc_id - 1, 'x' || doc_id, '{GHOST.strip()}', '{GHOST.strip()}' FROM toks WHERE ord = 0"""
ORACLES["e5_resolve"] = _mask("documents", _ASKED)
ORACLES["e6_resolve_identity"] = _mask("documents", f"{_ASKED} UNION ALL {_LOST}")
ORACLES["e7_llm_flow"] = _mask(
    "documents",
    f"""SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN masked_text WHEN 1 THEN '' END AS masked_input,
       CASE doc_id % 3 WHEN 0 THEN 's' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS session_id,
       CASE doc_id % 3 WHEN 1 THEN original_text END AS demasked_response,
       CASE doc_id % 3 WHEN 2 THEN '{FLOW_ERROR}' END AS error
       FROM masked JOIN replayed ON reply_id = doc_id""",
    more=(
        "replies AS (SELECT doc_id AS reply_id, doc_id AS session_id, masked_text AS txt FROM masked)",
        "maps AS (SELECT doc_id AS session_id, ord, token, value FROM toks)",
        o.replay_cte("replies", "maps"),
    ),
)
_FIND = r"regexp_extract_all(txt, '\{\{__OWL:[A-Z_]+_\d+__\}\}')"
ORACLES["e8_find_tokens"] = _mask(
    "documents",
    f"""SELECT reply_id, i AS ord, token, regexp_extract(token, '__OWL:([A-Z_]+)_', 1) AS token_type FROM (
        SELECT reply_id, unnest({_FIND}) AS token, unnest(range(len({_FIND}))) AS i FROM replies)""",
    more=(_REPLIES,),
)
ORACLES["e9_unresolved_tokens"] = f"SELECT doc_id AS reply_id, CAST(doc_id AS VARCHAR) AS session_id, '{GHOST.strip()}' AS token FROM documents"
ORACLES["e10_roundtrip"] = "SELECT doc_id, true AS same, md5(text) AS digest FROM documents"

# ------------------------------------------------------------------ vault

_EVENT_ROWS = " UNION ALL ".join(
    f"SELECT event_id, {i}::BIGINT AS ord, {token} AS token, {value} AS value FROM events" for i, (token, value) in enumerate(EVENT_TOKENS)
)
_OPS = f"""ops AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS op_id, ts, {OP_OF_EVENT} AS op FROM events),
    toks AS ({_EVENT_ROWS})"""


def _state(ttl: int = EVENT_TTL, as_of: str | None = AS_OF, where: str = "true") -> str:
    """CTEs on ``ops``: ``seen`` gives each operation its run and the last reset before it."""
    until = f"ts <= TIMESTAMP '{as_of}'" if as_of else "true"
    return f"""{_OPS},
    gaps AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL {ttl} SECOND THEN 1 ELSE 0 END AS cut
             FROM ops WHERE {until} AND {where} WINDOW w AS (PARTITION BY session_id ORDER BY ts, op_id)),
    runs AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY ts, op_id) AS run FROM gaps),
    seen AS (SELECT *, last_value(CASE WHEN op <> 'extend' THEN op END IGNORE NULLS) OVER w AS before,
                    last_value(CASE WHEN op <> 'extend' THEN op END IGNORE NULLS) OVER v AS after,
                    last_value(CASE WHEN op <> 'extend' THEN op_id END IGNORE NULLS) OVER v AS put_id,
                    max(run) OVER (PARTITION BY session_id) AS last_run, max(ts) OVER (PARTITION BY session_id, run) AS last_ts,
                    row_number() OVER (PARTITION BY session_id, run ORDER BY ts DESC, op_id DESC) AS back
             FROM runs
             WINDOW w AS (PARTITION BY session_id, run ORDER BY ts, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    v AS (PARTITION BY session_id, run ORDER BY ts, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    live AS (SELECT session_id, put_id, last_ts FROM seen WHERE back = 1 AND run = last_run AND after = 'put'
             AND TIMESTAMP '{as_of or AS_OF}' - last_ts < INTERVAL {ttl} SECOND),
    rows AS (SELECT s.session_id, s.ts, s.op_id, t.ord, t.token, t.value
             FROM seen s JOIN live l ON l.session_id = s.session_id AND s.put_id = l.put_id AND s.run = s.last_run
             JOIN toks t ON t.event_id = s.op_id WHERE s.op <> 'delete'),
    vault AS (SELECT session_id, arg_min(op_id, (ts, op_id, ord)) AS first_op, arg_min(ord, (ts, op_id, ord)) AS first_ord, token,
                     arg_max(value, (ts, op_id, ord)) AS value FROM rows GROUP BY session_id, token)"""


_ALWAYS = 1_000_000_000
_FLAT = "SELECT session_id, first_op, first_ord, token, value FROM vault"
ORACLES["f1_store"] = f"""WITH {_OPS},
    last AS (SELECT session_id, arg_max(op_id, (ts, op_id)) AS op_id FROM ops WHERE op = 'put' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL)
    SELECT session_id, op_id AS first_op, ord AS first_ord, token, value FROM last JOIN toks ON event_id = op_id"""
ORACLES["f2_overwrite"] = _mask(
    "contacts",
    """SELECT CAST(doc_id % 10 AS VARCHAR) AS session_id, token, value FROM toks
       WHERE doc_id IN (SELECT max(c_custkey) FROM customer GROUP BY c_custkey % 10)""",
)
ORACLES["f3_get_session"] = _sql(_state(), select=_FLAT + " WHERE session_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
ORACLES["f4_extend"] = _sql(
    _state(as_of=None), select="SELECT session_id, op_id, coalesce(before = 'put', false) AS done FROM seen WHERE op = 'extend'"
)
ORACLES["f4_extended_maps"] = _sql(_state(), select=_FLAT)
ORACLES["f5_delete"] = _sql(
    _state(as_of=None), select="SELECT session_id, op_id, coalesce(before = 'put', false) AS done FROM seen WHERE op = 'delete'"
)
ORACLES["f6_clear"] = f"""WITH {_OPS}
    SELECT session_id, arg_max(op_id, (ts, op_id)) AS put_id FROM ops WHERE op <> 'extend' AND ts <= TIMESTAMP '{AS_OF}'
    GROUP BY session_id HAVING arg_max(op, (ts, op_id)) = 'put'"""
ORACLES["f7_ttl"] = _sql(
    _state(), select=f"SELECT session_id, put_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_ts)) / 1e6 AS age_seconds FROM live"
)
ORACLES["f7_compacted"] = ORACLES["f4_extended_maps"]
ORACLES["f8_active_sessions"] = _sql(_state(), select="SELECT count(*) AS active_sessions FROM live")
ORACLES["f9_dual_store"] = _sql(
    _state(),
    f"lastput AS (SELECT session_id, arg_max(op_id, (ts, op_id)) AS op_id FROM ops WHERE op = 'put' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL)",
    select=_FLAT
    + """ UNION ALL SELECT session_id, op_id, ord, token, value FROM lastput JOIN toks ON event_id = op_id
          WHERE session_id NOT IN (SELECT session_id FROM vault)""",
)
ORACLES["f10_conversation_numbering"] = _mask(
    "documents",
    f"""SELECT doc_id // 8 AS conv, doc_id % 8 AS turn, entity_type,
        row_number() OVER (PARTITION BY doc_id // 8, entity_type ORDER BY doc_id, s, step) AS n, {_SPAN}, v AS value FROM kept""",
)

# ------------------------------------------------------------------ encryption

ORACLES["g1_period"] = "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS period, count(*) AS n_events FROM events GROUP BY 1"
_TOKEN_ROWS = f"""WITH {_OPS}, r AS (SELECT o.session_id, o.op_id, t.ord, t.token, t.value,
    CAST(floor(epoch(o.ts) / 86400) AS BIGINT) AS period FROM ops o JOIN toks t ON t.event_id = o.op_id WHERE op <> 'delete')"""
# HMAC-SHA256 spelled out: the hash of the padded key and the inner hash; the padded keys are constants
_EXTRACTED = hmac.new(bytes(32), validate_key(DEMO_KEYS["old"]), "sha256").digest()
_IN, _OUT = ("".join(f"{b ^ pad:02X}" for b in _EXTRACTED.ljust(64, b"\0")) for pad in (0x36, 0x5C))
_INFO = " || ".join(["'" + INFO.partition("{")[0] + "'", "period"])
_KEY = f"unhex(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({_INFO}) || unhex('01')))))"
ORACLES["g2_derived_keys"] = (
    _TOKEN_ROWS + f" SELECT 'old' AS key_id, period, count(*) AS n_values, sha256({_KEY}) AS key_digest FROM r GROUP BY period"
)
ORACLES["g3_encrypt"] = _TOKEN_ROWS + " SELECT session_id, op_id, ord, period, CAST(strlen(value) + 28 AS BIGINT) AS n_bytes FROM r"
ORACLES["g4_decrypt"] = _TOKEN_ROWS + " SELECT session_id, op_id, ord, token, value FROM r"
ORACLES["g4_decrypt_two_periods"] = (
    _TOKEN_ROWS + " SELECT period, count(*) FILTER (WHERE period IN (19742, 19741)) AS n_opened, count(*) AS n_values FROM r GROUP BY period"
)
ORACLES["g6_encryption_off"] = (
    _TOKEN_ROWS + " SELECT session_id, op_id, ord, token, value, CASE WHEN op_id % 2 = 0 THEN 'old' END AS key_id FROM r"
)
ORACLES["g7_rekey"] = _TOKEN_ROWS + " SELECT session_id, op_id, ord, 'new' AS key_id, value FROM r"

# ------------------------------------------------------------------ audit and statistics

ORACLES["h1_mask_events"] = _mask(
    "contacts",
    """SELECT CAST(doc_id AS VARCHAR) AS session_id, count(*) AS token_count,
       string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS token_types, true AS encrypted FROM toks GROUP BY doc_id""",
)
ORACLES["h1_extend_events"] = _sql(
    _state(as_of=None),
    select="""SELECT e.session_id, epoch_us(e.ts) AS ts_micros, count(DISTINCT token) AS token_count,
        string_agg(DISTINCT regexp_extract(token, '__OWL:([A-Z_]+)_', 1), ',' ORDER BY regexp_extract(token, '__OWL:([A-Z_]+)_', 1)) AS token_types,
        true AS encrypted
        FROM seen e JOIN seen s ON s.session_id = e.session_id AND s.run = e.run AND s.put_id = e.put_id AND s.op <> 'delete'
            AND (s.ts, s.op_id) <= (e.ts, e.op_id)
        JOIN toks t ON t.event_id = s.op_id
        WHERE e.op = 'extend' AND e.before = 'put' GROUP BY e.session_id, e.op_id, e.ts""",
)
ORACLES["h2_resolve_events"] = _mask(
    "documents",
    """SELECT 'resolve' AS event_type, CAST(doc_id AS VARCHAR) AS session_id, count(*) + 2 AS tokens_requested,
       count(*) + 1 AS tokens_resolved FROM toks GROUP BY doc_id""",
)
ORACLES["h3_delete_events"] = _sql(
    _state(as_of=None),
    select="SELECT 'delete' AS event_type, session_id, epoch_us(ts) AS ts_micros FROM seen WHERE op = 'delete' AND before = 'put'",
)
ORACLES["h4_expire_events"] = _sql(
    _state(),
    select=f"""SELECT 'expire' AS event_type, session_id, epoch_us(last_ts) + {EVENT_TTL * 1_000_000} AS ts_micros FROM seen
        WHERE back = 1 AND after = 'put' AND epoch_us(last_ts) + {EVENT_TTL * 1_000_000} <= epoch_us(TIMESTAMP '{AS_OF}')""",
)
ORACLES["h5_entity_counts"] = _mask(
    "documents",
    """SELECT entity_type, lang, count(*) AS n_findings FROM toks JOIN documents USING (doc_id)
       GROUP BY ROLLUP (entity_type, lang)""",
)
ORACLES["h6_pii_density"] = _mask(
    "documents",
    """SELECT source, CASE WHEN n_found = 0 THEN 'none' WHEN density >= 10 THEN 'high' WHEN density >= 1 THEN 'medium'
       ELSE 'low' END AS risk, count(*) AS n_texts, CAST(sum(n_found) AS BIGINT) AS n_findings, max(density) AS max_density
       FROM (SELECT source, n_found, n_found * 1000.0::DOUBLE / greatest(length(text), 1) AS density
             FROM masked JOIN documents USING (doc_id)) GROUP BY ALL""",
)
_TRUTH = (
        "lengths AS (SELECT c_custkey AS doc_id, " + ", ".join(f"{sql} AS {name}" for name, sql in CONTACT_LENGTHS.items()) + " FROM customer)",
        "truth AS (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS entity_type, {a} AS s, {b} AS e FROM lengths" for t, a, b in CONTACT_TRUTH) + ")",
    )
ORACLES["h7_detection_quality"] = _mask(
    "contacts",
    """SELECT entity_type, count(*) FILTER (WHERE f AND g) AS tp, count(*) FILTER (WHERE f AND g IS NULL) AS fp,
       count(*) FILTER (WHERE f IS NULL) AS fn,
       CASE WHEN count(f) > 0 THEN count(*) FILTER (WHERE f AND g) / count(f) ELSE 0 END::DOUBLE AS precision,
       CASE WHEN count(g) > 0 THEN count(*) FILTER (WHERE f AND g) / count(g) ELSE 0 END::DOUBLE AS recall,
       (2 * count(*) FILTER (WHERE f AND g) / (count(f) + count(g)))::DOUBLE AS f1
       FROM (SELECT DISTINCT doc_id, entity_type, s, e, true AS f FROM kept) a
       FULL JOIN (SELECT DISTINCT *, true AS g FROM truth) b
       USING (doc_id, entity_type, s, e) GROUP BY entity_type""",
    more=_TRUTH,
)
# pairs by falling share, each round taking those that are the best of both their spans
_ROUNDS = 4
_CREDIT = (
    "f AS (SELECT DISTINCT doc_id, entity_type, s, e FROM kept)",
    """left0 AS (SELECT f.doc_id, f.entity_type, f.s AS fs, f.e AS fe, t.s AS gs, t.e AS ge,
        (least(f.e, t.e) - greatest(f.s, t.s))::DOUBLE / (greatest(f.e, t.e) - least(f.s, t.s)) AS share
        FROM f JOIN (SELECT DISTINCT * FROM truth) t ON t.doc_id = f.doc_id AND t.entity_type = f.entity_type AND f.s < t.e AND t.s < f.e)""",
    *(
        part
        for k in range(_ROUNDS)
        for part in (
            f"""taken{k} AS (SELECT * FROM left{k} QUALIFY row_number() OVER (PARTITION BY doc_id, entity_type, fs, fe ORDER BY share DESC, gs, ge) = 1
        AND row_number() OVER (PARTITION BY doc_id, entity_type, gs, ge ORDER BY share DESC, fs, fe) = 1)""",
            f"""left{k + 1} AS (SELECT * FROM left{k} ANTI JOIN taken{k} USING (doc_id, entity_type, fs, fe)
        WHERE (doc_id, entity_type, gs, ge) NOT IN (SELECT (doc_id, entity_type, gs, ge) FROM taken{k}))""",
        )
    ),
    "taken AS (" + " UNION ALL ".join(f"SELECT * FROM taken{k}" for k in range(_ROUNDS)) + ")",
    """sums AS (SELECT entity_type, coalesce(n_found, 0) AS n_found, coalesce(n_true, 0) AS n_true, coalesce(n_partial, 0) AS n_partial,
        coalesce(n_exact, 0) AS n_exact, coalesce(credit, 0)::DOUBLE AS credit
        FROM (SELECT entity_type, count(*) AS n_found FROM f GROUP BY ALL)
        FULL JOIN (SELECT entity_type, count(*) AS n_true FROM (SELECT DISTINCT * FROM truth) GROUP BY ALL) USING (entity_type)
        LEFT JOIN (SELECT entity_type, count(*) FILTER (WHERE share >= 0.5) AS n_partial, count(*) FILTER (WHERE share = 1) AS n_exact, round(sum(share), 6) AS credit
            FROM taken GROUP BY ALL) USING (entity_type))""",
)
ORACLES["h7_partial_credit"] = _mask(
    "contacts",
    "SELECT *, "
    + ", ".join(
        f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0 END::DOUBLE AS {name}_{how}"
        for how, part in (("partial", "n_partial"), ("exact", "n_exact"), ("credit", "credit"))
        for name, whole in (("precision", "n_found"), ("recall", "n_true"))
    )
    + " FROM sums",
    more=(*_TRUTH, *_CREDIT),
)
ORACLES["h6_density_sketches"] = _mask(
    "documents",
    """SELECT source, rank::DOUBLE AS rank, count(*) AS n_texts, CAST(sum(n_found) AS BIGINT) AS n_findings, true AS near
       FROM masked JOIN documents USING (doc_id), (SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS rank) GROUP BY ALL""",
)
ORACLES["h8_case_counts"] = _spans(
    "contacts",
    "SELECT entity_type, pattern, count(*) AS n_cases FROM (SELECT DISTINCT entity_type, pattern, v FROM cand) GROUP BY ALL",
)

# ------------------------------------------------------------------ streams

ORACLES["i1_stream_mask"] = _mask("documents", _TEXT)
# arrival in thirds of the time, every seventh a batch later; late is what the watermark of the batches before has passed
_ARRIVED = f"""arrived AS (SELECT *, epoch_us(ts) AS us, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 3
        // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) + CASE WHEN op_id % 7 = 0 THEN 1 ELSE 0 END AS batch FROM ops),
    marks AS (SELECT b.batch, max(a.us) AS top FROM (SELECT DISTINCT batch FROM arrived) b LEFT JOIN arrived a ON a.batch < b.batch GROUP BY ALL),
    lates AS (SELECT op_id, coalesce(us < (top // 1000 - {DELAY_MINUTES * 60_000}) * 1000, false) AS late FROM arrived JOIN marks USING (batch))"""
ORACLES["i2_stream_session"] = _sql(
    _state(as_of=None, where="op_id NOT IN (SELECT op_id FROM lates WHERE late)").replace("    gaps AS", f"    {_ARRIVED},\n    gaps AS"),
    select="""SELECT session_id, op_id, op, op = 'put' OR coalesce(before = 'put', false) AS done, false AS late FROM seen
        UNION ALL SELECT session_id, op_id, op, false, true FROM ops JOIN lates USING (op_id) WHERE late""",
)
ORACLES["i3_stream_demask"] = _mask(
    "documents",
    """SELECT doc_id AS reply_id, CASE WHEN doc_id % 5 = 0 THEN masked_text ELSE text END AS original_text,
       CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_found END AS entities_restored, doc_id % 5 <> 0 AS resolved
       FROM masked JOIN documents USING (doc_id)""",
)
ORACLES["i3_stream_sessions"] = ORACLES["i3_stream_demask"]
ORACLES["i4_stream_dedup"] = "SELECT event_id, user_id FROM events"


def _windows(size: int, slide: int) -> str:
    return f"""SELECT w AS window_start, w + {size} AS window_end, event_type, count(*) AS n_events FROM (
        SELECT event_type, CAST(floor(epoch(ts) / {slide}) AS BIGINT) * {slide} - unnest(range(0, {size}, {slide})) AS w FROM events)
        GROUP BY ALL"""


ORACLES["i5_audit_tumbling"] = _windows(3600, 3600)
ORACLES["i5_audit_sliding"] = _windows(7200, 3600)
ORACLES["i5_audit_sessions"] = """SELECT user_id, min(epoch_us(ts)) AS window_start, max(epoch_us(ts)) + 21600000000 AS window_end,
    count(*) AS n_events FROM (
        SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut
            FROM events)) GROUP BY user_id, spell"""
# the last put or delete before a reply, and whether it is a put that is still live
_REPLIED = f"""{_OPS}, {_ARRIVED},
    before AS (SELECT r.op_id, r.session_id, r.ts, l.late, arg_max(o.op, (o.ts, o.op_id)) AS op, arg_max(o.op_id, (o.ts, o.op_id)) AS put_id, max(o.ts) AS last_ts
        FROM ops r JOIN lates l ON l.op_id = r.op_id
        LEFT JOIN (SELECT * FROM ops JOIN lates USING (op_id) WHERE NOT late) o ON o.session_id = r.session_id AND o.op <> 'extend' AND o.ts <= r.ts
        WHERE r.op = 'extend' GROUP BY ALL),
    replied AS (SELECT b.op_id AS reply_id, session_id, late, NOT late AND coalesce(op = 'put' AND ts - last_ts < INTERVAL {EVENT_TTL} SECOND, false) AS resolved, t.token, m.value
        FROM before b JOIN toks t ON t.event_id = b.op_id AND t.ord = 0 LEFT JOIN toks m ON m.event_id = b.put_id AND m.token = t.token)"""
ORACLES["i6_late_replies"] = (
    f"WITH {_REPLIED} SELECT reply_id, session_id, 'keep ' || token AS original_text, 0::BIGINT AS entities_restored, late FROM replied WHERE NOT resolved"
)
ORACLES["i6_every_reply"] = f"""WITH {_REPLIED} SELECT reply_id, session_id, 'keep ' || CASE WHEN resolved AND value IS NOT NULL THEN value ELSE token END AS original_text,
    CASE WHEN resolved AND value IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS entities_restored, resolved, late FROM replied"""
ORACLES["i7_stream_vault"] = _mask(
    "documents",
    "SELECT CAST(doc_id AS VARCHAR) AS session_id, n_found AS entities_found, n_found AS n_tokens, n_found AS token_count FROM masked",
)
