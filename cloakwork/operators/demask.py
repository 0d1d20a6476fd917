"""Restoring masked text and resolving tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.columns import settled
from cloakwork.functions.regex import sql_string
from cloakwork.functions.tokens import TOKEN_JAVA, TOKEN_TYPE_JAVA, restore
from cloakwork.plans.skew import join_hot
from cloakwork.plans.stored import stored

# The beginning of a token, at the end of a text: what follows could complete it.
_OPEN = r"\{[{}_A-Z\p{Nd}:]*"
_MARK = "\x01"


def demask(df: DataFrame, text: str = "masked_text", pairs: str = "token_map") -> DataFrame:
    """Restore ``text`` from a token map in the same row: adds ``original_text, entities_restored``."""
    done = settled(df, restore(f"`{text}`", f"`{pairs}`"), "_done")
    return done.select(
        *df.columns,
        F.col("_done.text").alias("original_text"),
        F.col("_done.restored").alias("entities_restored"),
    )


def find_tokens(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The tokens in each text, one row per occurrence: ``key``, the columns in ``more``, ``ord, token, token_type``."""
    every = F.posexplode_outer(F.expr(f"regexp_extract_all(`{text}`, {sql_string(TOKEN_JAVA)}, 0)")).alias("ord", "token")
    found = df.select(key, *more, every)
    return found.filter(F.col("token").isNotNull()).withColumn(
        "token_type", F.regexp_extract("token", TOKEN_TYPE_JAVA, 1)
    )


def demask_table(
    df: DataFrame,
    text: str = "text",
    pairs: str | None = None,
    session: str | None = None,
    vault: DataFrame | None = None,
) -> DataFrame:
    """Restore by a token map column if one is named, else by session: adds ``original_text,
    entities_restored`` to every row."""
    if pairs is not None:
        return demask(df, text, pairs)
    if session is None or vault is None:
        raise ValueError("Must provide either session_id or token_map")
    return restored_rows(df, vault, session, text)


def demask_sessions(
    replies: DataFrame, vault: DataFrame, key: str = "reply_id", session: str = "session_id", text: str = "text"
) -> DataFrame:
    """``restored_rows``, of which only ``key, original_text, entities_restored`` are kept."""
    return restored_rows(replies, vault, session, text).select(key, "original_text", "entities_restored")


def restored_rows(replies: DataFrame, vault: DataFrame, session: str = "session_id", text: str = "text") -> DataFrame:
    """Restore replies by their session: every row of ``replies`` with ``original_text, entities_restored``.

    ``vault`` holds ``session_id, ord, token, value``. Only the tokens that occur in a reply are looked up,
    by session and token together, so a session with very many tokens or replies spreads over tasks.
    An unknown session or token leaves the text as it is. What is found belongs to a session and a text: nothing else
    tells rows apart, so keys may repeat or be null.

    Looking up just those tokens is the same as replaying the whole map unless a replacement brings forth a
    further token. Where that could happen (a value that holds a token or the beginning of one, or such a
    beginning right before a token) the restored texts are searched again, round by round, until no round finds
    a token that the session knows.
    """
    rows = replies.select(
        F.struct(*[F.col(f"`{c}`") for c in replies.columns]).alias("_row"),
        F.col(session).cast("string").alias("_session"),
        F.col(text).alias("_text"),
    ).withColumn("_hash", F.sha2("_text", 256))
    known = vault.select(F.col("session_id").cast("string").alias("_session"), "token", "value", "ord")
    same = ["_session", "_hash"]
    wanted = rows.select(*same, F.explode(_tokens_in("_text")).alias("token")).distinct()
    hits = join_hot(wanted, known, ["_session", "token"])
    bare = F.regexp_replace("_text", TOKEN_JAVA, _MARK)
    nested = F.col("value").rlike(f"{TOKEN_JAVA}|{_OPEN}$")
    open_texts = rows.filter(bare.rlike(_OPEN + _MARK)).select(*same)
    odd = hits.filter(nested).select(*same).unionByName(open_texts).distinct()
    more = _further_hits(rows, hits, odd, known)
    hits = hits if more is None else hits.unionByName(more)
    found = hits.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("ord", "token", "value"))).alias("_found"))
    joined = rows.join(found, same, "left").withColumn("_pairs", F.expr(_PAIRS_OF.format("_found")))
    done = demask(joined, "_text", "_pairs")
    out = [F.col(f"_row.`{c}`").alias(c) for c in replies.columns if c not in ("original_text", "entities_restored")]
    return done.select(*out, "original_text", "entities_restored")


_PAIRS_OF = "transform({}, f -> named_struct('token', f.token, 'value', f.value))"


def _tokens_in(text: str) -> Column:
    return F.expr(f"array_distinct(regexp_extract_all({text}, {sql_string(TOKEN_JAVA)}, 0))")


def _further_hits(rows: DataFrame, hits: DataFrame, odd: DataFrame, known: DataFrame) -> DataFrame | None:
    """Tokens that only come to light while the ``odd`` texts are restored, with their values."""
    same = ["_session", "_hash"]
    if odd.isEmpty():
        return None
    texts = stored(rows.join(odd, same, "left_semi").select(*same, "_text").distinct())
    have = stored(hits.join(odd, same, "left_semi"))
    added = None
    while True:
        found = have.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("ord", "token", "value"))).alias("_found"))
        now = texts.join(found, same).withColumn("_pairs", F.expr(_PAIRS_OF.format("_found")))
        seen = demask(now, "_text", "_pairs").select(*same, F.explode(_tokens_in("original_text")).alias("token"))
        fresh = seen.join(have.select(*same, "token"), [*same, "token"], "left_anti")
        fresh = stored(join_hot(fresh, known, ["_session", "token"]))
        if fresh.isEmpty():
            return added
        added = fresh if added is None else added.unionByName(fresh)
        have = have.unionByName(fresh)


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """One vault out of two: a session's tokens come from ``first`` if it has any there, else ``second``."""
    known = first.select("session_id").distinct()
    return first.unionByName(join_hot(second, known, ["session_id"], "left_anti"))


def resolve_tokens(
    requests: DataFrame, vault: DataFrame, on_missing: str = "empty", key: str = "request_id"
) -> DataFrame:
    """Values of requested tokens, ``key, session_id, token, value``, one row per distinct token.

    ``requests`` holds ``key, session_id, tokens``. An unknown token stands for itself. A session without
    tokens gives no rows (``on_missing='empty'``) or the tokens themselves (``'identity'``).
    """
    if on_missing not in ("empty", "identity"):
        raise ValueError("on_missing must be 'empty' or 'identity'")
    asked = requests.select(key, "session_id", F.explode(F.array_distinct("tokens")).alias("token"))
    if on_missing == "empty":
        asked = join_hot(asked, vault.select("session_id").distinct(), ["session_id"], "left_semi")
    got = join_hot(asked, vault.select("session_id", "token", "value"), ["session_id", "token"], "left")
    return got.select(key, "session_id", "token", F.coalesce("value", "token").alias("value"))


def resolve_counts(requests: DataFrame, vault: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: tokens asked for (repeats counted) and those the session knows."""
    asked = requests.select(key, "session_id", F.explode("tokens").alias("token"))
    asked = join_hot(asked, vault.select("session_id").distinct(), ["session_id"], "left_semi")
    known = vault.select("session_id", "token", F.lit(1).alias("hit"))
    got = join_hot(asked, known, ["session_id", "token"], "left")
    return got.groupBy(key, "session_id").agg(
        F.count(F.lit(1)).alias("tokens_requested"), F.count("hit").alias("tokens_resolved")
    )


def unresolved_tokens(replies: DataFrame, vault: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens in replies that their own session does not know."""
    asked = find_tokens(replies, key, text, "session_id").select(key, "session_id", "token").distinct()
    known = vault.select("session_id", "token")
    return join_hot(asked, known, ["session_id", "token"], "left_anti").select(key, "session_id", "token")


def roundtrip_failures(masked: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose restored text differs from the original."""
    return demask(masked).filter(~F.col("original_text").eqNullSafe(F.col(text)))
