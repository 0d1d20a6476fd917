"""The registered queries. Keys begin with the operator they show; each reads the given tables whole."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.tokens import TOKEN_PREFIX, TOKEN_SUFFIX
from cloakwork.operators import audit, cache, compaction, crypto, demask, detect, flow, spans, synthetic, vault
from cloakwork.operators.analyze import analyze, finding_rows
from cloakwork.operators.mask import mask_table, token_rows
from cloakwork.plans import derived
from cloakwork.plans.stored import stored, work_folder
from cloakwork.sources import tables
from cloakwork.sources.rules import default_rules, extend_rules, rules_frame, without_rules
from cloakwork.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

URL_RULE = ("URL", "http", r"https?://[a-z0-9./?=&]+")
GHOST = f" {TOKEN_PREFIX}EMAIL_ADDRESS_99{TOKEN_SUFFIX}"
# A demonstration key; real ones come from the caller's secret store.
DEMO_KEYS = {"new": "bmV3LW1hc3Rlci1rZXktMzItYnl0ZXMtbG9uZy0tLS0=", "old": "b2xkLW1hc3Rlci1rZXktMzItYnl0ZXMtbG9uZy0tLS0="}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _register(name: str, fn: Query) -> None:
    REGISTRY[name] = fn


def _bigints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _masked(spark: SparkSession, folder: str, source: str = "documents", **options) -> DataFrame:
    df = {"documents": derived.documents, "pages": derived.pages, "contacts": derived.contacts}[source](spark, folder)
    key = "page_id" if source == "pages" else "doc_id"
    return mask_table(df, session=key, **options)


def _vault(spark: SparkSession, folder: str) -> DataFrame:
    return token_rows(_masked(spark, folder), "session_id")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """Rule matches in contacts, as a span table. Where it is read more than once, it is written first."""
    return detect.candidate_spans(derived.contacts(spark, folder)).withColumnRenamed("ord", "seq")


# ------------------------------------------------------------------ sources and sinks


@query
def a1_text_source(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        tables.table(spark, folder, name).select(
            F.lit(name).alias("source_table"), F.col(key).cast("long").alias("text_id"), F.col(text).alias("text")
        )
        for name, key, text in (
            ("documents", "doc_id", "text"),
            ("pages", "page_id", "html"),
            ("benchmark", "item_id", "text"),
            ("conversations", "conv_id", "text"),
        )
    ]
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return texts.groupBy("source_table").agg(
        F.count("text").alias("n_texts"),
        F.sum(F.length("text")).alias("n_chars"),
        F.count(F.when(F.trim("text") == "", 1)).alias("n_blank"),
    )


@query
def a2_masked_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Written, and read back."""
    path = f"{work_folder(spark)}/masked"
    tables.write_masked(_masked(spark, folder), path)
    return spark.read.parquet(path)


@query
def a3_vault_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of contacts are appended to a vault's log and every seventh session is deleted; what the log then holds."""
    path = f"{work_folder(spark)}/log"
    masked = _masked(spark, folder, "contacts").withColumn("ts", F.timestamp_seconds(F.col("doc_id")))
    tables.write_vault(vault.log_rows(masked, "put", "ts", "doc_id"), path, day="ts")
    # a deletion needs no mask
    gone = derived.contacts(spark, folder).filter("doc_id % 7 = 0").withColumn("ts", F.timestamp_seconds(F.col("doc_id")) + F.expr("interval 1 day"))
    tables.write_vault(vault.log_rows(gone, "delete", "ts", "doc_id", session="doc_id"), path, day="ts")
    log = spark.read.parquet(path).drop("day")
    kept = vault.current(log, F.to_timestamp(F.lit("2030-01-01")), 2_000_000_000)
    return kept.select("session_id", F.col("ord.ord").cast("long").alias("ord"), "token", "value")


@query
def a4_rule_source(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule, with how often it matches in the documents."""
    hits = detect.candidate_spans(derived.documents(spark, folder)).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    rules = rules_frame(spark)
    return _bigints(
        rules.join(hits, "ord", "left").select(
            "ord", "entity_type", "pattern", "enabled", F.coalesce("n", F.lit(0)).alias("n_matches")
        ),
        "ord",
    )


@query
def a5_external_spans(spark: SparkSession, folder: str) -> DataFrame:
    rules = _spans(spark, folder).select("doc_id", "entity_type", "pattern", "start", "end", "score")
    model = detect.map_labels(derived.model_findings(spark, folder)).select(
        "doc_id", "entity_type", F.lit(None).cast("string").alias("pattern"), "start", "end", "score"
    )
    both = _bigints(model.unionByName(rules), "start", "end")
    return both.withColumnsRenamed({"start": "span_start", "end": "span_end"})


@query
def a6_audit_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Appended, and read back."""
    path = f"{work_folder(spark)}/audit"
    if not audit.append_audit(audit.mask_events(_vault(spark, folder)), path):
        raise RuntimeError("no audit events were written")
    events = spark.read.parquet(path)
    return events.select("event_type", "session_id", "token_count", F.array_join("token_types", ",").alias("token_types"))


@query
def a7_stream_source(spark: SparkSession, folder: str) -> DataFrame:
    stream = streams.read_folder(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return streams.drain(stream, work_folder(spark))


# ------------------------------------------------------------------ detection


def _spans_out(df: DataFrame, *columns: str) -> DataFrame:
    out = _bigints(df, "start", "end").withColumnsRenamed({"start": "span_start", "end": "span_end"})
    return out.select(*columns, "span_start", "span_end", *[c for c in ("value",) if c in out.columns])


@query
def b1_regex_detect(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.candidate_spans(derived.documents(spark, folder))
    return _spans_out(_bigints(found, "ord"), "doc_id", "ord", "entity_type", "pattern")


@query
def b1_regex_detect_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.candidate_spans(derived.pages(spark, folder), "page_id")
    return _spans_out(_bigints(found, "ord"), "page_id", "ord", "entity_type", "pattern")


@query
def b1_regex_detect_contacts(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.candidate_spans(derived.contacts(spark, folder))
    return _spans_out(_bigints(found, "ord"), "doc_id", "ord", "entity_type", "pattern")


def _stub_loader():
    # made here, so that it travels with the task and workers need not import this package
    def load():
        import re

        pattern = re.compile(r"[a-z]+\.[0-9]+@")
        return lambda texts: [[("person", m.start(), m.end() - 1, 0.75) for m in pattern.finditer(t)] for t in texts]

    return load


@query
def b2_model_detect(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.map_labels(detect.model_spans(derived.documents(spark, folder), _stub_loader()))
    return _spans_out(found, "doc_id", "label", "entity_type", "score")


@query
def b3_label_map(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.map_labels(derived.model_findings(spark, folder))
    return found.groupBy("label", "entity_type").agg(F.count(F.lit(1)).alias("n_spans"))


@query
def b4_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _spans_out(detect.above_threshold(derived.model_findings(spark, folder)), "doc_id", "label", "score")


def _contacts_with_model(spark: SparkSession, folder: str) -> DataFrame:
    model = derived.model_findings(spark, folder)
    return detect.with_external(derived.contacts(spark, folder), model, threshold=0.5)


@query
def b5_analyze(spark: SparkSession, folder: str) -> DataFrame:
    found = analyze(_contacts_with_model(spark, folder), external="external")
    rows = finding_rows(found, "doc_id").withColumnRenamed("text", "value")
    return _spans_out(_bigints(rows, "pos"), "doc_id", "pos", "entity_type", "pattern", "score")


DETECTORS = {
    "b7_1_detect_email": "EMAIL_ADDRESS",
    "b7_2_detect_phone": "PHONE_NUMBER",
    "b7_3_detect_card": "CREDIT_CARD",
    "b7_4_detect_national_id": "US_SSN",
    "b7_5_detect_crypto": "CRYPTO_ADDRESS",
    "b7_6_detect_secret": "API_KEY",
    "b7_7_detect_ip": "IP_ADDRESS",
    "b7_8_detect_iban": "IBAN_CODE",
    "b7_9_detect_mac": "MAC_ADDRESS",
}


def _detector(entity_type: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        parts = [
            detect.detect_type(source(spark, folder).select("doc_id", "text"), entity_type).select(F.lit(name).alias("origin"), "*")
            for name, source in (("documents", derived.documents), ("contacts", derived.contacts))
        ]
        return _spans_out(parts[0].unionByName(parts[1]), "origin", "doc_id", "pattern")

    return run


for _name, _kind in DETECTORS.items():
    _register(_name, _detector(_kind))


@query
def b8_rule_extension(spark: SparkSession, folder: str) -> DataFrame:
    rules = extend_rules(without_rules(default_rules(), [("EMAIL_ADDRESS", "quoted")]), [URL_RULE])
    found = detect.candidate_spans(derived.pages(spark, folder), "page_id", rules=rules)
    return _spans_out(_bigints(found, "ord"), "page_id", "ord", "entity_type", "pattern")


@query
def b9_luhn(spark: SparkSession, folder: str) -> DataFrame:
    cards = detect.detect_type(derived.contacts(spark, folder), "CREDIT_CARD")
    return _spans_out(detect.luhn_valid(cards), "doc_id", "pattern")


@query
def b10_distinct_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.detect_distinct(derived.documents(spark, folder))
    return _spans_out(_bigints(found, "ord"), "doc_id", "ord", "entity_type", "pattern")


@query
def b10_cached_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run over nine of ten documents fills the cache; a run over all of them matches the rest only."""
    docs, root = derived.documents(spark, folder), work_folder(spark)
    cache.detect_cached(docs.filter("doc_id % 10 <> 0"), root, "first")
    found, _ = cache.detect_cached(docs, root, "second")
    return _spans_out(_bigints(found, "ord"), "doc_id", "ord", "entity_type", "pattern")


@query
def b10_cache_use(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct texts each of three runs had to match: nine of ten documents, all, all again."""
    docs, root = derived.documents(spark, folder), work_folder(spark)
    runs = [("1", docs.filter("doc_id % 10 <> 0")), ("2", docs), ("3", docs)]
    return spark.createDataFrame([(name, cache.detect_cached(some, root, name)[1]) for name, some in runs], "run string, n_matched long")


# ------------------------------------------------------------------ spans


@query
def c1_filter_types(spark: SparkSession, folder: str) -> DataFrame:
    masked = _masked(spark, folder, "contacts", entities_to_mask=["EMAIL_ADDRESS", "IBAN_CODE"])
    return masked.select("doc_id", "masked_text", F.size("entities_found").cast("long").alias("n_found"))


def _kept(spark: SparkSession, folder: str, mode: str = "compat") -> DataFrame:
    return spans.resolve_overlaps(_spans(spark, folder), mode=mode)


@query
def c2_resolve_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return _spans_out(_kept(spark, folder), "doc_id", "entity_type", "pattern")


@query
def c2_resolve_longest(spark: SparkSession, folder: str) -> DataFrame:
    return _spans_out(_kept(spark, folder, "longest"), "doc_id", "entity_type", "pattern")


@query
def c2_resolve_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = finding_rows(analyze(derived.documents(spark, folder)), "doc_id").withColumnRenamed("text", "value")
    return _spans_out(_bigints(rows, "pos"), "doc_id", "pos", "entity_type", "pattern")


@query
def c3_islands(spark: SparkSession, folder: str) -> DataFrame:
    out = spans.islands(_spans(spark, folder).select("doc_id", "start", "end", "seq"), chunk=256)
    return out.groupBy("doc_id", "island").agg(
        F.min("start").cast("long").alias("island_start"),
        F.max("end").cast("long").alias("island_end"),
        F.count(F.lit(1)).alias("n_spans"),
    )


@query
def c4_order_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _spans_out(spans.order_spans(_kept(spark, folder), chunk=256), "doc_id", "place", "entity_type")


@query
def c5_span_count(spark: SparkSession, folder: str) -> DataFrame:
    masked = _masked(spark, folder)
    return masked.select("doc_id", F.size("entities_found").cast("long").alias("entities_found"))


@query
def c6_overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = spans.overlap_counts(stored(_spans(spark, folder).drop("value")), chunk=256)
    return _spans_out(_bigints(out, "seq"), "doc_id", "seq", "overlaps")


@query
def c6_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """The model's findings in contacts against the rules' matches."""
    model = detect.map_labels(derived.model_findings(spark, folder))
    return audit.agreement(model, stored(_spans(spark, folder).select("doc_id", "entity_type", "pattern", "start", "end")))


# ------------------------------------------------------------------ masking


@query
def d1_make_token(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_rows(_masked(spark, folder), "doc_id")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_texts"))


@query
def d2_number_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _spans_out(spans.number_tokens(_kept(spark, folder), chunk=256), "doc_id", "entity_type", "n")


@query
def d3_mask(spark: SparkSession, folder: str) -> DataFrame:
    return _masked(spark, folder, "contacts").select("doc_id", "masked_text")


@query
def d3_mask_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _masked(spark, folder, "pages").select("page_id", "masked_text")


@query
def d4_token_map(spark: SparkSession, folder: str) -> DataFrame:
    return _bigints(token_rows(_masked(spark, folder), "doc_id"), "ord")


@query
def d5_session_key(spark: SparkSession, folder: str) -> DataFrame:
    """Turns without a named session get a random one of 36 characters."""
    turns = tables.table(spark, folder, "conversations")
    turns = turns.withColumn("sid", F.when(F.col("role") == "user", F.col("conv_id")))
    out = mask_table(turns, session="sid")
    return out.groupBy("role").agg(
        F.count(F.when(F.length("session_id") == 36, 1)).alias("n_generated"),
        F.count(F.when(F.col("session_id") == F.col("conv_id").cast("string"), 1)).alias("n_given"),
    )


@query
def d6_mask_table(spark: SparkSession, folder: str) -> DataFrame:
    return _masked(spark, folder).select(
        "doc_id", "masked_text", F.size("entities_found").cast("long").alias("n_entities")
    )


@query
def d6_mask_with_model(spark: SparkSession, folder: str) -> DataFrame:
    masked = mask_table(_contacts_with_model(spark, folder), session="doc_id", external="external")
    return masked.select("doc_id", "masked_text", F.size("entities_found").cast("long").alias("n_entities"))


@query
def d6_mask_training_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Masked texts of good quality that are not toxic. The choice is made before masking."""
    labels = tables.table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    chosen = derived.documents(spark, folder).join(labels, "doc_id", "left_semi")
    return mask_table(chosen, session="doc_id").select("doc_id", "masked_text")


def _strategy(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _masked(spark, folder, strategy=name).select("doc_id", "masked_text")

    return run


for _name, _kind in {
    "d7_redact": "REDACT",
    "d8_truncate": "TRUNCATE",
    "d9_hash": "HASH",
    "d11_synthetic": "SYNTHETIC",
}.items():
    _register(_name, _strategy(_kind))


@query
def d11_fake_values(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and contacts with stand-ins from a table of made-up values."""
    fakes = derived.fake_values(spark, folder)
    sources = (("documents", derived.documents), ("contacts", derived.contacts))
    parts = [
        synthetic.mask_with_fakes(source(spark, folder).select("doc_id", "text"), fakes, session="doc_id").select(F.lit(name).alias("origin"), "doc_id", "masked_text")
        for name, source in sources
    ]
    return parts[0].unionByName(parts[1])


@query
def d10_tokenize(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that depend on the value only: one vault row per value."""
    rows = token_rows(_masked(spark, folder, strategy="TOKENIZE"), "doc_id")
    return rows.groupBy("token", "value").agg(F.count(F.lit(1)).alias("n_texts"))


# ------------------------------------------------------------------ restoring


def _stored_masked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The masked documents, written once, and their vault rows."""
    masked = stored(_masked(spark, folder).select("doc_id", "text", "session_id", "masked_text", "token_map"))
    return masked, token_rows(masked, "session_id")


def _replies(masked: DataFrame) -> DataFrame:
    """Every masked document comes back as a reply with a made-up token at its end."""
    return masked.select(
        F.col("doc_id").alias("reply_id"), "session_id", F.concat("masked_text", F.lit(GHOST)).alias("text")
    )


@query
def e1_demask(spark: SparkSession, folder: str) -> DataFrame:
    masked = _masked(spark, folder).withColumn("reply", F.concat("masked_text", F.lit(GHOST)))
    return _bigints(
        demask.demask(masked, "reply").select(F.col("doc_id").alias("reply_id"), "original_text", "entities_restored"),
        "entities_restored",
    )


@query
def e2_demask_session(spark: SparkSession, folder: str) -> DataFrame:
    """Every third session is unknown to the vault."""
    masked, rows = _stored_masked(spark, folder)
    known = rows.filter("cast(session_id as bigint) % 3 <> 0")
    return _bigints(demask.demask_sessions(_replies(masked), known), "entities_restored")


@query
def e4_demask_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """Two vaults; the first has every other session and other values."""
    masked, second = _stored_masked(spark, folder)
    first = second.filter("cast(session_id as bigint) % 2 = 0").withColumn("value", F.concat(F.lit("#"), "value"))
    out = demask.demask_sessions(_replies(masked), demask.prefer(first, second))
    return _bigints(out, "entities_restored")


def _requests(masked: DataFrame) -> DataFrame:
    """Each document with findings asks for all its tokens, for the first one twice, and for an unknown one; a
    session that does not exist asks for the same."""
    ghost, tokens = F.lit(GHOST.strip()), F.col("token_map.token")
    asked = masked.filter(F.size("token_map") > 0)
    known = asked.select(
        F.col("doc_id").alias("request_id"), "session_id", F.concat(tokens, F.array(ghost, tokens[0])).alias("tokens")
    )
    lost = asked.select(
        (-F.col("doc_id") - 1).alias("request_id"),
        F.concat(F.lit("x"), "session_id").alias("session_id"),
        F.concat(tokens, F.array(ghost)).alias("tokens"),
    )
    return known.unionByName(lost)


@query
def e5_resolve(spark: SparkSession, folder: str) -> DataFrame:
    masked, rows = _stored_masked(spark, folder)
    return demask.resolve_tokens(_requests(masked), rows)


@query
def e6_resolve_identity(spark: SparkSession, folder: str) -> DataFrame:
    masked, rows = _stored_masked(spark, folder)
    return demask.resolve_tokens(_requests(masked), rows, on_missing="identity")


@query
def e7_llm_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in turn ask, get an answer, and get an empty answer."""
    masked, rows = _stored_masked(spark, folder)
    kind = F.col("doc_id") % 3
    asked = masked.select(
        F.col("doc_id").alias("request_id"),
        F.col("text").alias("user_input"),
        F.when(kind == 1, F.col("masked_text")).when(kind == 2, F.lit("")).alias("llm_response"),
        F.when(kind != 0, F.col("session_id")).alias("session_id"),
        F.concat(F.lit("s"), F.col("doc_id")).alias("new_id"),
    )
    return flow.run_flow(asked, rows, "new_id")[0]


@query
def e8_find_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _bigints(demask.find_tokens(_replies(_masked(spark, folder)), "reply_id", "text"), "ord")


@query
def e9_unresolved_tokens(spark: SparkSession, folder: str) -> DataFrame:
    masked, rows = _stored_masked(spark, folder)
    return demask.unresolved_tokens(_replies(masked), rows, "reply_id", "text")


@query
def e10_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    restored = demask.demask(_masked(spark, folder))
    return restored.select(
        "doc_id", F.col("original_text").eqNullSafe(F.col("text")).alias("same"), F.md5("original_text").alias("digest")
    )


# ------------------------------------------------------------------ vault


def _as_of():
    return F.to_timestamp(F.lit(derived.AS_OF))


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return vault.current(derived.session_log(spark, folder), _as_of(), derived.EVENT_TTL)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "session_id", F.col("ord.op_id").alias("first_op"), F.col("ord.ord").cast("long").alias("first_ord"), "token", "value"
    )


@query
def f1_store(spark: SparkSession, folder: str) -> DataFrame:
    """Puts alone, without expiry: the last one wins."""
    log = derived.session_log(spark, folder).filter("op = 'put'")
    return _flat(vault.current(log, _as_of(), 1_000_000_000))


@query
def f2_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts share ten sessions; masking the next one replaces its map."""
    masked = _masked(spark, folder, "contacts").select(
        (F.col("doc_id") % 10).alias("session_id"),
        "doc_id",
        F.timestamp_seconds(F.col("doc_id")).alias("ts"),
        "token_map",
    )
    # read twice: for the live sessions and for their rows
    log = stored(vault.log_rows(masked, "put", "ts", "doc_id"))
    return vault.current(log, F.to_timestamp(F.lit("2030-01-01")), 2_000_000_000).select("session_id", "token", "value")


@query
def f3_get_session(spark: SparkSession, folder: str) -> DataFrame:
    wanted = tables.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    return _flat(vault.get_sessions(derived.session_log(spark, folder), wanted, _as_of(), derived.EVENT_TTL))


@query
def f4_extend(spark: SparkSession, folder: str) -> DataFrame:
    out = vault.outcomes(derived.session_log(spark, folder), derived.EVENT_TTL)
    return out.filter("op = 'extend'").select("session_id", "op_id", "done")


@query
def f4_extended_maps(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_current(spark, folder))


@query
def f5_delete(spark: SparkSession, folder: str) -> DataFrame:
    out = vault.outcomes(derived.session_log(spark, folder), derived.EVENT_TTL)
    return out.filter("op = 'delete'").select("session_id", "op_id", "done")


@query
def f6_clear(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions left after clearing: the clear of an unknown session passes silently."""
    live = vault.live_sessions(derived.session_log(spark, folder), _as_of(), 1_000_000_000)
    return live.select("session_id", "put_id")


@query
def f7_ttl(spark: SparkSession, folder: str) -> DataFrame:
    live = vault.live_sessions(derived.session_log(spark, folder), _as_of(), derived.EVENT_TTL)
    age = (F.unix_micros(_as_of()) - F.unix_micros("last_ts")) / 1e6
    return live.select("session_id", "put_id", age.alias("age_seconds"))


@query
def f7_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The vault after ten and eighteen days were compacted and all older days deleted."""
    root = work_folder(spark)
    compaction.append(derived.session_log(spark, folder), root)
    for day in (date(2024, 1, 11), date(2024, 1, 19)):
        compaction.compact(spark, root, day, derived.EVENT_TTL)
        compaction.retire(spark, root, day)
    return _flat(compaction.current(spark, root, _as_of(), date.fromisoformat(derived.AS_OF[:10]), derived.EVENT_TTL))


@query
def f8_active_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return vault.active_sessions(derived.session_log(spark, folder), _as_of(), derived.EVENT_TTL)


@query
def f9_dual_store(spark: SparkSession, folder: str) -> DataFrame:
    """Live sessions from the log; others fall back to the last map ever put."""
    log = derived.session_log(spark, folder)
    primary = vault.current(log, _as_of(), derived.EVENT_TTL)
    fallback = vault.current(log.filter("op = 'put'"), _as_of(), 1_000_000_000)
    return _flat(demask.prefer(primary, fallback))


@query
def f10_conversation_numbering(spark: SparkSession, folder: str) -> DataFrame:
    """Eight documents in a row make a conversation."""
    found = finding_rows(analyze(derived.documents(spark, folder)), "doc_id").withColumnRenamed("text", "value")
    found = found.withColumn("conv", F.floor(F.col("doc_id") / 8)).withColumn("turn", F.col("doc_id") % 8)
    out = vault.number_conversation(found, "conv", "turn", chunk=2)
    return _spans_out(out, "conv", "turn", "entity_type", "n")


# ------------------------------------------------------------------ encryption


@query
def g1_period(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return events.groupBy(crypto.key_period(F.col("ts")).alias("period")).agg(F.count(F.lit(1)).alias("n_events"))


def _sealed(spark: SparkSession, folder: str, period_seconds: int = crypto.PERIOD_SECONDS) -> tuple[DataFrame, DataFrame]:
    rows = derived.session_log(spark, folder).filter(F.col("token").isNotNull())
    keys = crypto.key_frame(spark, DEMO_KEYS, crypto.periods_of(rows, period_seconds=period_seconds))
    return crypto.encrypt_values(rows, keys, "old", period_seconds=period_seconds), keys


@query
def g2_derived_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Which key each period of the log uses; keys are shown by digest only."""
    sealed, keys = _sealed(spark, folder)
    used = sealed.groupBy("key_id", "period").agg(F.count(F.lit(1)).alias("n_values"))
    return used.join(keys, ["key_id", "period"]).select("key_id", "period", "n_values", F.sha2("key_bytes", 256).alias("key_digest"))


@query
def g3_encrypt(spark: SparkSession, folder: str) -> DataFrame:
    """Sealed values: 12 bytes of nonce and 16 of tag around the text."""
    sealed, _ = _sealed(spark, folder)
    return sealed.select("session_id", "op_id", F.col("ord").cast("long").alias("ord"), "period", F.length("sealed").cast("long").alias("n_bytes"))


@query
def g4_decrypt(spark: SparkSession, folder: str) -> DataFrame:
    sealed, keys = _sealed(spark, folder)
    opened = crypto.decrypt_values(sealed, keys, ["new", "old"])
    return opened.select("session_id", "op_id", F.col("ord").cast("long").alias("ord"), "token", "value")


@query
def g4_decrypt_two_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Reading on the log's day 20 of 2024: only that day and the one before can be opened."""
    sealed, keys = _sealed(spark, folder)
    opened = crypto.decrypt_values(sealed, keys, ["new", "old"], as_of_period=19742)
    return opened.groupBy("period").agg(F.count("value").alias("n_opened"), F.count(F.lit(1)).alias("n_values"))


@query
def g6_encryption_off(spark: SparkSession, folder: str) -> DataFrame:
    """Every other operation was stored while encryption was off; one read gives the values of both kinds."""
    rows = derived.session_log(spark, folder).filter(F.col("token").isNotNull())
    keys = crypto.key_frame(spark, DEMO_KEYS, crypto.periods_of(rows))
    columns = ["session_id", "op_id", "ord", "token", "value", "sealed", "key_id", "period"]
    sealed = crypto.store_values(rows.filter("op_id % 2 = 0"), keys, "old").select(*columns)
    plain = crypto.store_values(rows.filter("op_id % 2 = 1")).select(*columns)
    kept = stored(sealed.unionByName(plain)).withColumn("stored_with", F.col("key_id"))
    opened = crypto.read_values(kept, keys, ["new", "old"])
    return opened.select("session_id", "op_id", F.col("ord").cast("long").alias("ord"), "token", "value", F.col("stored_with").alias("key_id"))


@query
def g7_rekey(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly keys."""
    sealed, keys = _sealed(spark, folder, 3600)
    again = crypto.rekey(sealed, keys, ["old"], "new")
    opened = crypto.decrypt_values(again, keys, ["new"])
    return opened.select("session_id", "op_id", F.col("ord").cast("long").alias("ord"), "key_id", "value")


# ------------------------------------------------------------------ audit and statistics


def _events_out(events: DataFrame) -> DataFrame:
    return events.withColumn("token_types", F.array_join("token_types", ","))


@query
def h1_mask_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_rows(_masked(spark, folder, "contacts"), "session_id")
    return _events_out(audit.mask_events(rows, encrypted=True)).select("session_id", "token_count", "token_types", "encrypted")


@query
def h1_extend_events(spark: SparkSession, folder: str) -> DataFrame:
    """An extend that takes effect publishes the merged map's figures."""
    merged = vault.merged_maps(derived.session_log(spark, folder), derived.EVENT_TTL)
    events = _events_out(audit.extend_events(merged, encrypted=True))
    return events.select("session_id", F.unix_micros("ts").alias("ts_micros"), "token_count", "token_types", "encrypted")


@query
def h2_resolve_events(spark: SparkSession, folder: str) -> DataFrame:
    masked, rows = _stored_masked(spark, folder)
    counts = demask.resolve_counts(_requests(masked), rows)
    return audit.resolve_events(counts).select("event_type", "session_id", "tokens_requested", "tokens_resolved")


@query
def h3_delete_events(spark: SparkSession, folder: str) -> DataFrame:
    events = audit.delete_events(vault.outcomes(derived.session_log(spark, folder), derived.EVENT_TTL))
    return events.select("event_type", "session_id", F.unix_micros("ts").alias("ts_micros"))


@query
def h4_expire_events(spark: SparkSession, folder: str) -> DataFrame:
    events = audit.expire_events(vault.expired_sessions(derived.session_log(spark, folder), _as_of(), derived.EVENT_TTL))
    return events.select("event_type", "session_id", F.unix_micros("ts").alias("ts_micros"))


@query
def h5_entity_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = analyze(derived.documents(spark, folder))
    rows = found.select("lang", "source", F.explode_outer("found").alias("f")).select("lang", "source", "f.entity_type")
    return audit.entity_counts(rows.filter(F.col("entity_type").isNotNull()), "lang")


@query
def h6_pii_density(spark: SparkSession, folder: str) -> DataFrame:
    out = audit.pii_density(_masked(spark, folder))
    return out.groupBy("source", "risk").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("n_findings").alias("n_findings"), F.max("density").alias("max_density")
    )


RANKS = [0.1, 0.5, 0.9, 0.99]


@query
def h6_density_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches by source and day, merged by source; whether each answer is as near to its rank as the sketch promises."""
    density = audit.pii_density(_masked(spark, folder)).select("source", "density", "n_findings", F.expr("doc_id div 100").alias("day"))
    density = stored(density)
    merged = audit.merged_sketches(stored(audit.density_sketches(density, "source", "day")), "source")
    found = audit.density_at(merged, RANKS).withColumnsRenamed({"density": "cut"})
    below = density.select(F.col("source").alias("_source"), "density").join(found, F.col("_source").eqNullSafe(F.col("source")))
    counted = below.groupBy("source", "rank", "n_texts", "n_findings").agg(
        F.count(F.when(F.col("density") < F.col("cut"), 1)).alias("lower"), F.count(F.when(F.col("density") <= F.col("cut"), 1)).alias("upper")
    )
    error = F.lit(audit.SKETCH_ERROR) * F.col("n_texts") + 1
    near = (F.col("lower") <= F.col("rank") * F.col("n_texts") + error) & (F.col("upper") >= F.col("rank") * F.col("n_texts") - error)
    return counted.select("source", "rank", "n_texts", "n_findings", near.alias("near"))


@query
def h7_detection_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Kept findings of contacts against what the contacts were made to hold."""
    found = finding_rows(analyze(derived.contacts(spark, folder)), "doc_id")
    return audit.detection_quality(found, derived.contact_truth(spark, folder))


@query
def h7_partial_credit(spark: SparkSession, folder: str) -> DataFrame:
    """The same findings with credit for overlaps, found and true spans matched one to one."""
    found = finding_rows(analyze(derived.contacts(spark, folder)), "doc_id")
    return audit.partial_quality(found, derived.contact_truth(spark, folder))


@query
def h8_case_counts(spark: SparkSession, folder: str) -> DataFrame:
    cases = detect.candidate_spans(derived.contacts(spark, folder)).select("entity_type", "pattern", "value").distinct()
    return audit.case_counts(cases, "entity_type", "pattern")


# ------------------------------------------------------------------ streams


@query
def i1_stream_mask(spark: SparkSession, folder: str) -> DataFrame:
    stream = streams.read_folder(spark, folder, "documents")
    masked = streams.stream_mask(stream, "text", "doc_id").select("doc_id", "masked_text")
    return streams.drain(masked, work_folder(spark))


DELAY_MINUTES = 15
DELAY = f"{DELAY_MINUTES} minutes"


def _arriving(df: DataFrame, work: str, batches: int = 4, files: int = 2) -> DataFrame:
    """``df`` (``session_id, ts, op_id`` and more) as a stream that arrives in the thirds of its time, one micro-batch each. Every
    seventh row comes one batch later than it should, most of them behind the watermark by then. At last comes a row of a
    year later in a session of its own, which lets everything before it go."""
    df = stored(df)  # read once for its bounds and once for each batch
    us = F.unix_micros("ts")
    low, high = df.agg(F.min(us), F.max(us)).first()
    third = F.expr(f"(unix_micros(ts) - {low or 0}) * 3 div {(high or 0) - (low or 0) + 1}")
    batch = third + F.when(F.col("op_id") % 7 == 0, 1).otherwise(0)
    later = df.select(F.expr("max_by(struct(*), ts)").alias("r")).select("r.*")
    later = later.withColumns({"ts": F.expr("ts + interval 366 days"), "session_id": F.lit("later")})
    for i, part in enumerate([*(df.filter(batch == i) for i in range(batches)), later]):
        part.repartition(files if i < batches else 1).write.parquet(f"{work}/in/part={i}")
        time.sleep(0.01)
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
    return stream.parquet(f"{work}/in")


def _session_events(spark: SparkSession, folder: str) -> DataFrame:
    """The operations of the events, with their tokens."""
    log = derived.session_log(spark, folder)
    maps = log.groupBy("session_id", "ts", "op_id", "op").agg(F.sort_array(F.collect_list(F.struct("ord", "token", "value"))).alias("m"))
    maps = maps.withColumn("m", F.filter("m", lambda p: p["token"].isNotNull()))
    return maps.select(
        "session_id", "ts", "op_id", "op", F.col("m.token").alias("tokens"), F.col("m.value").alias("values"), F.lit(None).cast("string").alias("text")
    )


@query
def i2_stream_session(spark: SparkSession, folder: str) -> DataFrame:
    """Events in four micro-batches, some behind the watermark: those are told as late and take no effect."""
    work = work_folder(spark)
    stream = _arriving(_session_events(spark, folder), work)
    out = streams.stream_sessions(stream, derived.EVENT_TTL, DELAY).select("session_id", "op_id", "op", "done", "late")
    return streams.drain(out, work).filter("session_id <> 'later'")


def _masks_and_replies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each document is masked at its own second; its reply comes ten minutes later, for every fifth one after twenty: too late."""
    masked = stored(_masked(spark, folder).select("doc_id", "session_id", "masked_text", "token_map"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    wait = F.when(F.col("doc_id") % 5 == 0, F.expr("interval 20 minutes")).otherwise(F.expr("interval 10 minutes"))
    masks = masked.select("session_id", at.alias("ts"), F.col("doc_id").alias("op_id"), "token_map")
    replies = masked.select("session_id", (at + wait).alias("ts"), F.col("doc_id").alias("op_id"), F.col("masked_text").alias("text"))
    return masks, replies


def _as_they_come(df: DataFrame, work: str, name: str, files: int = 2) -> DataFrame:
    """``df`` as a stream in no order of time, in two micro-batches, and then a row of a year later."""
    later = df.select(F.expr("max_by(struct(*), ts)").alias("r")).select("r.*")
    later = later.withColumns({"ts": F.expr("ts + interval 366 days"), "session_id": F.lit("later")})
    for i, part in enumerate([df.filter("op_id % 2 = 0"), df.filter("op_id % 2 = 1"), later]):
        part.repartition(files if i < 2 else 1).write.parquet(f"{work}/{name}/part={i}")
        time.sleep(0.01)
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
    return stream.parquet(f"{work}/{name}")


@query
def i3_stream_demask(spark: SparkSession, folder: str) -> DataFrame:
    """Masks and replies as two streams, joined by token within the time to live. The delay is longer than the documents' times
    are apart, so nothing is late."""
    work = work_folder(spark)
    masks, replies = _masks_and_replies(spark, folder)
    span = masks.agg(F.max("op_id") - F.min("op_id")).first()[0] or 0
    out = streams.stream_demask_join(
        _as_they_come(replies, work, "replies").withColumnRenamed("op_id", "reply_id"),
        _as_they_come(masks, work, "masks").withColumnRenamed("ts", "mask_ts"),
        delay=f"{span + 1800} seconds",
    )
    out = streams.drain(_bigints(out, "entities_restored"), work).filter("session_id <> 'later'")
    return out.select("reply_id", "original_text", "entities_restored", "resolved")


@query
def i3_stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The same masks and replies by the state of each session, where values may hold tokens."""
    work = work_folder(spark)
    masks, replies = _masks_and_replies(spark, folder)
    none = F.lit(None)
    puts = masks.select(
        "session_id", "ts", "op_id", F.lit("put").alias("op"), F.col("token_map.token").alias("tokens"), F.col("token_map.value").alias("values"),
        none.cast("string").alias("text"),
    )
    asked = replies.select(
        "session_id", "ts", "op_id", F.lit("reply").alias("op"), none.cast("array<string>").alias("tokens"), none.cast("array<string>").alias("values"), "text"
    )
    out = streams.restored_replies(streams.stream_sessions(_arriving(puts.unionByName(asked), work), delay="365 days"))
    out = streams.drain(_bigints(out, "entities_restored"), work).filter("session_id <> 'later'")
    return out.select("reply_id", "original_text", "entities_restored", "resolved")


@query
def i4_stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives twice."""
    events = streams.read_folder(spark, folder, "events", "ts").select("event_id", "user_id", "ts")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = streams.stream_dedup(twice, ["event_id"], "ts").select("event_id", "user_id")
    return streams.drain(out, work_folder(spark))


def _window_query(size: str, slide: str | None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = streams.read_folder(spark, folder, "events", "ts")
        out = streams.audit_windows(events, "ts", size, slide)
        out = streams.drain(out, work_folder(spark), "complete")
        return out.select(
            F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"), "event_type", "n_events"
        )

    return run


_register("i5_audit_tumbling", _window_query("1 hour", None))
_register("i5_audit_sliding", _window_query("2 hours", "1 hour"))


@query
def i5_audit_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = streams.read_folder(spark, folder, "events", "ts")
    out = streams.session_windows(events, "ts", "user_id", "6 hours")
    out = streams.drain(out, work_folder(spark), "complete")
    return out.select(
        "user_id", F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "n_events"
    )


def _with_replies(events: DataFrame) -> DataFrame:
    """Extends as replies that hold a token."""
    reply = F.col("op") == "extend"
    return events.withColumn("text", F.when(reply, F.concat(F.lit("keep "), F.col("tokens")[0]))).withColumn(
        "op", F.when(reply, "reply").otherwise(F.col("op"))
    )


def _all_replies(spark: SparkSession, folder: str, work: str) -> DataFrame:
    events = _with_replies(_session_events(spark, folder))
    replies = streams.restored_replies(streams.stream_sessions(_arriving(events, work), derived.EVENT_TTL, DELAY))
    return _bigints(replies, "entities_restored")


@query
def i6_late_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies to sessions that have gone by then, and replies behind the watermark, leave unchanged, on a route of their own."""
    work = work_folder(spark)
    out = streams.drain(streams.unresolved(_all_replies(spark, folder, work)), work).filter("session_id <> 'later'")
    return out.select("reply_id", "session_id", "original_text", "entities_restored", "late")


@query
def i6_every_reply(spark: SparkSession, folder: str) -> DataFrame:
    """Both routes together hold every reply once."""
    work = work_folder(spark)
    out = streams.drain(_all_replies(spark, folder, work), work).filter("session_id <> 'later'")
    return out.select("reply_id", "session_id", "original_text", "entities_restored", "resolved", "late")


@query
def i7_stream_vault(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    masked = streams.stream_mask(streams.read_folder(spark, folder, "documents"), "text", "doc_id")
    paths = {name: f"{work}/{name}" for name in ("masked", "vault", "audit")}
    streams.write_stream(masked, paths, f"{work}/checkpoint").awaitTermination()
    rows = spark.read.parquet(paths["vault"]).groupBy("session_id").agg(F.count("token").alias("n_tokens"))
    events = spark.read.parquet(paths["audit"]).select("session_id", "token_count")
    masked_rows = spark.read.parquet(paths["masked"]).select("session_id", "entities_found")
    return masked_rows.join(rows, "session_id", "left").join(events, "session_id", "left").select(
        "session_id", "entities_found", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("token_count", F.lit(0)).alias("token_count")
    )

