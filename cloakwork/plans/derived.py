"""Inputs derived from the given tables by plain SQL expressions, so they grow with them.

``CONTACT_TEXT`` turns every customer into a text with one value for most kinds of rule, made from hashes
of the key: the prose tables hold no account numbers, hardware addresses or wallets. Only functions that
Spark and DuckDB share are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.plans.spread import spread, spread_few, spread_small
from cloakwork.sources.tables import table

_H = "md5(cast(c_custkey as varchar(20)))"
_G = "md5('g' || cast(c_custkey as varchar(20)))"
_D = f"translate({_H}, 'abcdef', '012345')"


def _part(value: str, start: int, length: int) -> str:
    return f"substr({value}, {start}, {length})"


def _joined(value: str, width: int, count: int, separator: str) -> str:
    return f" || '{separator}' || ".join(_part(value, 1 + width * i, width) for i in range(count))


_VALUES = {
    "mail": f"{_part(_H, 1, 6)} || '@mail.example.com'",
    "phone": f"'+1 (' || {_part(_D, 1, 3)} || ') ' || {_part(_D, 4, 3)} || '-' || {_part(_D, 7, 4)}",
    "card": f"'4' || {_part(_D, 1, 15)}",
    "paid": f"'5' || '1' || {_part(_D, 3, 2)} || '-' || {_part(_D, 5, 4)} || '-' || {_part(_D, 9, 4)} || '-' || {_part(_D, 13, 4)}",
    "ssn": f"{_part(_D, 1, 3)} || '-' || {_part(_D, 4, 2)} || '-' || {_part(_D, 6, 4)}",
    "nino": f"'AB' || {_part(_D, 1, 6)} || 'C'",
    "coin": f"'1' || translate({_part(_H, 1, 30)}, '0', 'z')",
    "segwit": f"'bc1' || {_H} || {_part(_G, 1, 10)}",
    "ether": f"'0x' || {_H} || {_part(_G, 1, 8)}",
    "cloud": f"'AKIA' || upper({_part(_H, 1, 16)})",
    "maps": f"'AIza' || {_H} || {_part(_G, 1, 3)}",
    "repo": f"'ghp_' || {_H} || {_part(_G, 1, 4)}",
    "pay": f"'sk_live_' || {_part(_H, 1, 24)}",
    "chat": f"'sk-' || {_H} || {_part(_G, 1, 16)}",
    "uuid": f"{_part(_H, 1, 8)} || '-' || {_joined(_G, 4, 3, '-')} || '-' || {_part(_H, 9, 12)}",
    "jwt": f"'eyJ' || {_part(_H, 1, 8)} || '.eyJ' || {_part(_G, 1, 8)} || '.' || {_part(_H, 9, 8)}",
    "six": _joined(_H, 4, 8, ":"),
    "link": f"'fe80::' || {_part(_H, 1, 4)}",
    "iban": f"'DE' || {_part(_D, 1, 20)}",
    "gb": f"'GB' || {_part(_D, 1, 2)} || 'NWBK' || {_part(_D, 3, 14)}",
    "mac": _joined(_H, 2, 6, ":"),
    "dash": _joined(_G, 2, 6, "-"),
    "dots": _joined(_H, 4, 3, "."),
}
CONTACT_TEXT = "'Kontakt ' || c_name" + "".join(f" || ' {name} ' || {value}" for name, value in _VALUES.items())

# What the values are, as a person would label them: the truth that detection is held against. Every value has a label.
# National numbers of all countries have the type US_SSN in the rule table; a uuid stands for an Azure key.
_TRUE_TYPES = {
    "mail": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "card": "CREDIT_CARD", "paid": "CREDIT_CARD", "ssn": "US_SSN",
    "nino": "US_SSN", "coin": "CRYPTO_ADDRESS", "segwit": "CRYPTO_ADDRESS", "ether": "CRYPTO_ADDRESS", "cloud": "API_KEY",
    "maps": "API_KEY", "repo": "API_KEY", "pay": "API_KEY", "chat": "API_KEY", "uuid": "API_KEY", "jwt": "API_KEY",
    "six": "IP_ADDRESS", "link": "IP_ADDRESS", "iban": "IBAN_CODE", "gb": "IBAN_CODE", "mac": "MAC_ADDRESS",
    "dash": "MAC_ADDRESS", "dots": "MAC_ADDRESS",
}


# Lengths of the parts of a contact text, and from them the place of each value.
CONTACT_LENGTHS = {"head": "length('Kontakt ' || c_name)"} | {f"n_{name}": f"length({value})" for name, value in _VALUES.items()}


def _truth() -> list[tuple[str, str, str]]:
    """Entity type, start and end (as SQL over the lengths) of each value of a contact text."""
    before, out = "head", []
    for name in _VALUES:
        before += f" + {len(name) + 2}"
        out.append((_TRUE_TYPES[name], before, f"{before} + n_{name}"))
        before += f" + n_{name}"
    return out


CONTACT_TRUTH = _truth()

# Two made-up model findings per contact, some on rule matches, with scores on both sides of the rules'.
MODEL_LABELS = [
    "person", "email", "phone number", "social security number", "credit card", "bitcoin address",
    "ethereum address", "IBAN", "AWS key", "API key", "password", "JWT token", "address", "IP address",
    "medical license", "licence plate",
]
_LABEL_LIST = ", ".join(f"'{x}'" for x in MODEL_LABELS)
FINDINGS = [
    ("(c_custkey * 7) % 200", "5 + c_custkey % 20", "((c_custkey * 37) % 100) / 100.0", 0),
    ("(c_custkey * 13) % 300", "3 + c_custkey % 31", "(90 + (c_custkey * 11) % 10) / 100.0", 5),
]

# Each event is an operation on its user's session; the token map has two tokens.
OP_OF_EVENT = "case event_type when 'signup' then 'put' when 'view' then 'put' when 'error' then 'delete' else 'extend' end"
EVENT_TOKENS = [
    ("'{{__OWL:API_KEY_' || cast(event_id % 5 + 1 as varchar(20)) || '__}}'", "props"),
    ("'{{__OWL:EMAIL_ADDRESS_' || cast(event_id % 3 + 1 as varchar(20)) || '__}}'", "'user' || cast(event_id as varchar(20)) || '@example.com'"),
]
EVENT_TTL = 21_600
AS_OF = "2024-01-20 00:00:00"


# Made-up values, as many for each type as there are customers.
FAKE_VALUES = {
    "EMAIL_ADDRESS": "'person' || cast(c_custkey as varchar(20)) || '@example.org'",
    "PHONE_NUMBER": "'(555) 01' || cast(c_custkey as varchar(20))",
    "CREDIT_CARD": "'0000-' || cast(c_custkey as varchar(20))",
    "IP_ADDRESS": "'192.0.2.' || cast(c_custkey as varchar(20))",
}


def fake_values(spark: SparkSession, folder: str) -> DataFrame:
    """``entity_type, fake_value``."""
    rows = ", ".join(f"struct('{kind}' AS entity_type, {value} AS fake_value)" for kind, value in FAKE_VALUES.items())
    return table(spark, folder, "customer").select(F.explode(F.expr(f"array({rows})")).alias("f")).select("f.*")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_few(table(spark, folder, "documents"), "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread_few(table(spark, folder, "pages").select("page_id", F.col("html").alias("text")), "page_id")


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread_small(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey")
    return rows.select(F.col("c_custkey").alias("doc_id"), F.expr(CONTACT_TEXT).alias("text"))


def contact_truth(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, entity_type, start, end``: what the contacts were made to hold."""
    rows = ", ".join(f"struct('{kind}' AS entity_type, {start} AS start, {end} AS end)" for kind, start, end in CONTACT_TRUTH)
    lengths = [F.expr(sql).alias(name) for name, sql in CONTACT_LENGTHS.items()]
    rows_of = spread_small(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey")
    sized = rows_of.select(F.col("c_custkey").alias("doc_id"), *lengths)
    return sized.select("doc_id", F.explode(F.expr(f"array({rows})")).alias("t")).select("doc_id", "t.*")


def model_findings(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, rank, label, start, end, score`` for the contacts."""
    rows = table(spark, folder, "customer").select("c_custkey")
    parts = [
        rows.select(
            F.col("c_custkey").alias("doc_id"),
            F.lit(rank).alias("rank"),
            F.expr(f"array({_LABEL_LIST})[cast((c_custkey + {shift}) % {len(MODEL_LABELS)} as int)]").alias("label"),
            F.expr(f"cast({start} as int)").alias("start"),
            F.expr(f"cast({start} + {length} as int)").alias("end"),
            F.expr(f"cast({score} as double)").alias("score"),
        )
        for rank, (start, length, score, shift) in enumerate(FINDINGS)
    ]
    return parts[0].unionByName(parts[1])


def session_log(spark: SparkSession, folder: str) -> DataFrame:
    """The session log told by the events."""
    events = spread(table(spark, folder, "events"), "event_id").select(
        "event_id", "user_id", "event_type", "props", F.col("ts").cast("timestamp").alias("ts")
    )
    pairs = ", ".join(f"named_struct('token', {token}, 'value', {value})" for token, value in EVENT_TOKENS)
    op = F.expr(OP_OF_EVENT)
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        op.alias("op"),
        F.col("event_id").alias("op_id"),
        "ts",
        F.posexplode_outer(F.when(op != "delete", F.expr(f"array({pairs})"))).alias("ord", "p"),
    ).select("session_id", "op", "op_id", "ts", "ord", "p.token", "p.value")
