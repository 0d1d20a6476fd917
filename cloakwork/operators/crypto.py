"""Encryption of vault values with keys derived per time period.

Keys reach the executors as a small joined table, never as literals in a plan. Every value is sealed on
its own, bound to its session and token, so a large session needs no large row.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD_SECONDS = 86400
INFO = "vault-session-key-period-{period}"


def key_period(ts: Column, period_seconds: int = PERIOD_SECONDS) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(period_seconds)).cast("long")


def validate_key(master_key: str, name: str = "master key") -> bytes:
    """The 32 bytes of a URL-safe base64 key, or ValueError."""
    try:
        raw = base64.b64decode(master_key.encode(), altchars=b"-_", validate=True)
    except (binascii.Error, UnicodeEncodeError, AttributeError) as exc:
        raise ValueError(f"Invalid {name}: not URL-safe base64") from exc
    if len(raw) != 32:
        raise ValueError(f"Invalid {name}: must be 32 bytes when decoded")
    return raw


def hkdf_sha256(secret: bytes, info: bytes, length: int = 32, salt: bytes = b"") -> bytes:
    """HKDF with SHA-256 (RFC 5869): extract, then expand."""
    extracted = hmac.new(salt or b"\0" * 32, secret, hashlib.sha256).digest()
    out, block = b"", b""
    while len(out) < length:
        block = hmac.new(extracted, block + info + bytes([len(out) // 32 + 1]), hashlib.sha256).digest()
        out += block
    return out[:length]


def derive_key(master_key: str, period: int, info: str = INFO) -> bytes:
    """The 32-byte key of a period; ``info`` names it."""
    return hkdf_sha256(validate_key(master_key), info.format(period=period).encode())


def key_frame(spark: SparkSession, masters: dict[str, str], periods: list[int], info: str = INFO) -> DataFrame:
    """``key_id, period, key_bytes`` for every master key and period."""
    if not masters:
        raise RuntimeError("no master key was given")
    rows = [(kid, p, bytearray(derive_key(mk, p, info))) for kid, mk in masters.items() for p in periods]
    return spark.createDataFrame(rows, "key_id string, period long, key_bytes binary")


def periods_of(df: DataFrame, ts: str = "ts", period_seconds: int = PERIOD_SECONDS) -> list[int]:
    """The periods present, one row each."""
    rows = df.select(key_period(F.col(ts), period_seconds).alias("p")).filter("p is not null").distinct().collect()
    return sorted(r.p for r in rows)


def _aad() -> Column:
    return F.concat_ws("|", "session_id", "token")


def _seal(value: str, key_bytes: str) -> Column:
    """The sealed value; a value without a key is an error, never dropped."""
    sealed = F.aes_encrypt(
        F.col(value).cast("binary"), F.col(key_bytes), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _aad().cast("binary")
    )
    missing = F.raise_error(F.concat(F.lit("no key for period "), F.coalesce(F.col("period").cast("string"), F.lit("null"))))
    return F.when(F.col(value).isNull(), None).when(F.col(key_bytes).isNotNull(), sealed).otherwise(missing.cast("binary"))


def encrypt_values(rows: DataFrame, keys: DataFrame, key_id: str, ts: str = "ts", period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    """Replace ``value`` by ``sealed`` (AES-GCM) with the key of its period; adds ``key_id, period``.

    Keys go to the rows: a row for each period, all of whose values would else be brought together in one task.

    A value whose period has no key, or that has no time, stops the job. A null value stays null.
    """
    mine = F.broadcast(keys.filter(F.col("key_id") == key_id))
    out = rows.withColumn("period", key_period(F.col(ts), period_seconds)).join(mine, "period", "left")
    return out.withColumn("sealed", _seal("value", "key_bytes")).drop("key_bytes", "value")


def store_values(
    rows: DataFrame, keys: DataFrame | None = None, key_id: str | None = None, ts: str = "ts", period_seconds: int = PERIOD_SECONDS
) -> DataFrame:
    """Rows as a vault stores them: ``value`` or ``sealed`` with ``key_id`` and ``period``, the others null.

    Sealed if keys are given, else plain. ``read_values`` reads both kinds, also mixed in one table.
    """
    if keys is None:
        none = {c: F.lit(None).cast(t) for c, t in (("sealed", "binary"), ("key_id", "string"), ("period", "long"))}
        return rows.withColumns(none)
    return encrypt_values(rows, keys, key_id, ts, period_seconds).withColumn("value", F.lit(None).cast("string"))


def read_values(rows: DataFrame, keys: DataFrame | None = None, key_ids: list[str] | None = None, as_of_period: int | None = None) -> DataFrame:
    """Rows of ``store_values`` with their ``value``: plain ones as they are, sealed ones opened, null where no key fits."""
    if keys is None:
        return rows.drop("sealed", "key_id", "period")
    opened = decrypt_values(rows.withColumnRenamed("value", "_plain"), keys, key_ids or [], as_of_period)
    return opened.withColumn("value", F.coalesce("_plain", "value")).drop("_plain", "key_id", "period")


def decrypt_values(
    rows: DataFrame, keys: DataFrame, key_ids: list[str], as_of_period: int | None = None
) -> DataFrame:
    """Open ``sealed`` into ``value``; null where no key fits, which counts as absent.

    A row names the key it was sealed with, so one look-up finds it if it is among ``key_ids``. Rows
    without a name are tried with each key in that order (current first), for the period they carry.
    With ``as_of_period`` only that period and the one before it can be opened.
    """

    def opened(key_bytes: str) -> Column:
        return F.try_aes_decrypt(
            F.col("sealed"), F.col(key_bytes), F.lit("GCM"), F.lit("DEFAULT"), _aad().cast("binary")
        )

    if "key_id" in rows.columns:
        named = F.broadcast(keys.filter(F.col("key_id").isin(key_ids)).withColumnRenamed("key_bytes", "_k0"))
        out, tries = rows.join(named, ["period", "key_id"], "left"), ["_k0"]
    else:
        out, tries = rows, [f"_k{i}" for i in range(len(key_ids))]
        for name, kid in zip(tries, key_ids):
            mine = keys.filter(F.col("key_id") == kid).select("period", F.col("key_bytes").alias(name))
            out = out.join(F.broadcast(mine), "period", "left")
    value = F.coalesce(*[opened(name) for name in tries]).cast("string")
    if as_of_period is not None:
        value = F.when(F.col("period").isin(as_of_period, as_of_period - 1), value)
    return out.withColumn("value", value).drop("sealed", *tries)


def rekey(rows: DataFrame, keys: DataFrame, old_ids: list[str], new_id: str) -> DataFrame:
    """Seal again under ``new_id`` what the old keys can open, each value in the period it carries.

    What none of them opens is returned as it is, still sealed under its old key.
    """
    was = rows.withColumns({"_sealed": F.col("sealed"), "_key_id": F.col("key_id")})
    opened = decrypt_values(was, keys, old_ids).drop("key_id")
    mine = keys.filter(F.col("key_id") == new_id).select("period", F.col("key_bytes").alias("_new"))
    out = opened.join(F.broadcast(mine), "period", "left")
    done = F.col("value").isNotNull()
    return out.select(
        *[c for c in rows.columns if c not in ("sealed", "key_id")],
        F.when(done, _seal("value", "_new")).otherwise(F.col("_sealed")).alias("sealed"),
        F.when(done, F.lit(new_id)).otherwise(F.col("_key_id")).alias("key_id"),
    )
