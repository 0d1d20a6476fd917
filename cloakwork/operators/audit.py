"""Audit events, statistics and detection quality."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.tokens import TOKEN_TYPE_JAVA
from cloakwork.operators.spans import overlapping_pairs
from cloakwork.plans.skew import join_large
from cloakwork.plans.stored import stored
from cloakwork.schemas import AUDIT

AUDIT_COLUMNS = [part.split()[0] for part in AUDIT.split(", ")]


def _event(df: DataFrame, event_type: str, **columns: Column) -> DataFrame:
    types = dict(part.split() for part in AUDIT.split(", "))
    columns["event_type"] = F.lit(event_type)
    return df.select(*[columns.get(c, F.lit(None)).cast(types[c]).alias(c) for c in AUDIT_COLUMNS])


def mask_events(rows: DataFrame, encrypted: bool = False, ts: str | None = None) -> DataFrame:
    """One event per session (and moment): token count and the types among them. Types are few, so the
    set is small whatever the session's size."""
    keys = ["session_id"] + ([ts] if ts else [])
    kind = F.regexp_extract("token", TOKEN_TYPE_JAVA, 1)
    per = rows.groupBy(*keys).agg(F.count("token").alias("n"), F.array_sort(F.collect_set(kind)).alias("types"))
    moment = {"ts": F.col(ts)} if ts else {}
    return _event(
        per, "mask", session_id=F.col("session_id"), token_count=F.col("n"), token_types=F.col("types"),
        encrypted=F.lit(encrypted), **moment,
    )


def extend_events(merged: DataFrame, encrypted: bool = False) -> DataFrame:
    """Mask events of extends, with the merged map's figures: from ``vault.merged_maps``."""
    return _event(
        merged, "mask", session_id=F.col("session_id"), token_count=F.col("token_count"), token_types=F.col("token_types"),
        encrypted=F.lit(encrypted), ts=F.col("ts"),
    )


def resolve_events(counts: DataFrame) -> DataFrame:
    """Events of ``demask.resolve_counts``."""
    return _event(
        counts, "resolve", session_id=F.col("session_id"), tokens_requested=F.col("tokens_requested"),
        tokens_resolved=F.col("tokens_resolved"),
    )


def delete_events(outcomes: DataFrame) -> DataFrame:
    """Events of deletions that took effect."""
    done = outcomes.filter((F.col("op") == "delete") & F.col("done"))
    return _event(done, "delete", session_id=F.col("session_id"), ts=F.col("ts"))


def expire_events(expired: DataFrame) -> DataFrame:
    return _event(expired, "expire", session_id=F.col("session_id"), ts=F.col("expired_ts"))


def append_audit(events: DataFrame, path: str, mode: str = "append") -> bool:
    """Append events; failing to record one never fails the work it tells of."""
    try:
        events.write.mode(mode).parquet(path)
    except Exception as exc:  # noqa: BLE001  whatever the store raises
        logging.getLogger(__name__).warning("audit events not recorded: %s", type(exc).__name__)
        return False
    return True


def entity_counts(findings: DataFrame, *dims: str) -> DataFrame:
    """Findings per type and dimension, with subtotals."""
    return findings.rollup("entity_type", *dims).agg(F.count(F.lit(1)).alias("n_findings"))


# Findings per 1,000 characters at which a text's risk band begins.
RISK_BANDS = ((10.0, "high"), (1.0, "medium"), (0.0, "low"))


def pii_density(masked: DataFrame, text: str = "text") -> DataFrame:
    """Findings per 1,000 characters and the band that puts a text in."""
    density = F.size("entities_found") * F.lit(1000.0) / F.greatest(F.length(text), F.lit(1))
    out = masked.withColumn("n_findings", F.size("entities_found").cast("long")).withColumn("density", density)
    (high, high_name), (medium, medium_name), (_, low_name) = RISK_BANDS
    band = (
        F.when(F.col("n_findings") == 0, "none")
        .when(F.col("density") >= high, high_name)
        .when(F.col("density") >= medium, medium_name)
        .otherwise(low_name)
    )
    return out.withColumn("risk", band)


#: Size of a density sketch; its answers are off by ``SKETCH_ERROR`` of the ranks at most, with 99 % confidence.
SKETCH_SIZE, SKETCH_ERROR = 200, 0.0165
BAND_RANKS = ((0.99, "high"), (0.9, "medium"), (0.0, "low"))


def density_sketches(density: DataFrame, *by: str) -> DataFrame:
    """A quantile sketch of ``density`` for each group, with ``n_texts`` and ``n_findings``: small rows that can be stored, and
    merged with those of other days by ``merged_sketches``."""
    return density.groupBy(*by).agg(
        F.kll_sketch_agg_double("density", F.lit(SKETCH_SIZE)).alias("sketch"), F.count(F.lit(1)).alias("n_texts"), F.sum("n_findings").alias("n_findings")
    )


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups, from those of their parts; no text is read again."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n_texts").alias("n_texts"), F.sum("n_findings").alias("n_findings")
    )


def density_at(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """``rank, density`` for each sketch and rank (0 to 1), beside the sketch's other columns."""
    keep = [c for c in sketches.columns if c != "sketch"]
    answers = [F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("density")) for r in ranks]
    return sketches.select(*keep, F.explode(F.array(*answers)).alias("a")).select(*keep, "a.*")


def risk_by_distribution(density: DataFrame, sketches: DataFrame, *by: str) -> DataFrame:
    """Add ``risk``: where a text's density stands among those of its group, by the group's merged sketch. A text without findings
    has none; above the ranks of ``BAND_RANKS`` the risk is that band's."""
    cuts = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank))).alias(f"_{name}") for rank, name in BAND_RANKS]
    bounds = sketches.select(*[F.col(c).alias(f"_by_{c}") for c in by], *cuts)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    band = F.when(F.col("n_findings") == 0, "none")
    for _, name in BAND_RANKS:
        band = band.when(F.col("density") >= F.col(f"_{name}"), name)
    return density.join(bounds, same, "left").withColumn("risk", band.otherwise(BAND_RANKS[-1][1])).select(*[c for c in density.columns if c != "risk"], "risk")


def detection_quality(found: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact-span precision, recall and F1 per entity type."""
    ident = [key, "entity_type", "start", "end"]
    both = (
        found.select(*ident).distinct().withColumn("_f", F.lit(1))
        .join(gold.select(*ident).distinct().withColumn("_g", F.lit(1)), ident, "full")
    )
    counts = both.groupBy("entity_type").agg(
        F.count(F.when(F.col("_f").isNotNull() & F.col("_g").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("_g").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "entity_type", "tp", "fp", "fn",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def agreement(model: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """How a model's spans (``key, label, entity_type, start, end``) and rule matches (``key, pattern, entity_type, start, end``)
    lie on each other: per label and rule the pairs that overlap, those of one entity type (``n_agree``), of two
    (``n_conflict``), and those with the same bounds. Spans that meet none have a row with null on the other side.
    """
    ours = model.select(key, "label", "entity_type", "start", "end").withColumn("_id", F.struct(key, "start", "end", "label"))
    theirs = rules.select(key, "pattern", "entity_type", "start", "end").withColumn("_id", F.struct(key, "start", "end", "entity_type", "pattern"))
    pairs = stored(
        overlapping_pairs(ours, theirs, key).select(
            F.col("l._id").alias("_l"), F.col("r._id").alias("_r"), "l.label", "r.pattern", F.col("r.entity_type").alias("rule_type"),
            (F.col("l.entity_type") == F.col("r.entity_type")).alias("_same"),
            ((F.col("l.start") == F.col("r.start")) & (F.col("l.end") == F.col("r.end"))).alias("_exact"),
        )
    )
    alone = [
        join_large(ours.select(F.col("_id").alias("_l"), "label"), pairs.select("_l").distinct(), ["_l"], "left_anti").select(
            "label", F.lit(None).cast("string").alias("rule_type"), F.lit(None).cast("string").alias("pattern")
        ),
        join_large(theirs.select(F.col("_id").alias("_r"), F.col("entity_type").alias("rule_type"), "pattern"), pairs.select("_r").distinct(), ["_r"], "left_anti").select(
            F.lit(None).cast("string").alias("label"), "rule_type", "pattern"
        ),
    ]
    none = [F.lit(None).cast("boolean").alias(c) for c in ("_same", "_exact")]
    every = pairs.select("label", "rule_type", "pattern", "_same", "_exact")
    for rest in alone:
        every = every.unionByName(rest.select("*", *none))
    return every.groupBy("label", "rule_type", "pattern").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_same"), 1)).alias("n_agree"),
        F.count(F.when(~F.col("_same"), 1)).alias("n_conflict"), F.count(F.when(F.col("_exact"), 1)).alias("n_exact"),
    )


def matched_spans(found: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Found and true spans of one type matched one to one: ``key, entity_type, f_start, f_end, g_start, g_end, share``.

    ``share`` is the overlap over the union of the two. Pairs are taken by falling share, then by their places, and each span once, as if
    one by one: a pair that is the best one of both its spans is taken at once, so a round takes many, and what is
    left after it is stored for the next. Rounds are as many as the longest chain of spans that give way to each other.
    """
    sides = [x.select(key, "entity_type", "start", "end").distinct() for x in (found, gold)]
    sides = [x.withColumn("_doc", F.struct(key, "entity_type")) for x in sides]
    common = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    union = F.greatest("l.end", "r.end") - F.least("l.start", "r.start")
    left = stored(
        overlapping_pairs(*sides, "_doc").select(
            F.col("l._doc").alias("_doc"), F.col("l.start").alias("f_start"), F.col("l.end").alias("f_end"),
            F.col("r.start").alias("g_start"), F.col("r.end").alias("g_end"), (common / union).alias("share"),
        )
    )
    out = None
    rank = F.struct((-F.col("share")).alias("s"), "f_start", "f_end", "g_start", "g_end")
    while not left.isEmpty():
        ours, theirs = ["_doc", "f_start", "f_end"], ["_doc", "g_start", "g_end"]
        ranked = left.withColumn("_rank", rank)
        best = [ranked.groupBy(*side).agg(F.min("_rank").alias("_best")) for side in (ours, theirs)]
        taken = ranked
        for side, least in zip((ours, theirs), best):
            taken = join_large(taken, least.withColumnRenamed("_best", "_rank"), [*side, "_rank"], "left_semi")
        taken = stored(taken.drop("_rank"))
        out = taken if out is None else out.unionByName(taken)
        for side in (ours, theirs):
            left = join_large(left, taken.select(*side), side, "left_anti")
        left = stored(left)
    out = left if out is None else out
    return out.select("_doc.*", "f_start", "f_end", "g_start", "g_end", "share")


def partial_quality(found: DataFrame, gold: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Per entity type: spans found and true, matched pairs at a share of ``least`` and exact ones, the sum of all shares to six places, and
    precision and recall for each of the three."""
    # both are read three times, and finding spans may be costly
    found, gold = (stored(x.select(key, "entity_type", "start", "end")) for x in (found, gold))
    matched = matched_spans(found, gold, key).groupBy("entity_type").agg(
        F.count(F.when(F.col("share") >= least, 1)).alias("n_partial"), F.count(F.when(F.col("share") == 1, 1)).alias("n_exact"),
        F.round(F.sum("share"), 6).alias("credit"),
    )
    counts = [x.select(key, "entity_type", "start", "end").distinct().groupBy("entity_type").agg(F.count(F.lit(1)).alias(n)) for x, n in ((found, "n_found"), (gold, "n_true"))]
    all_types = counts[0].join(counts[1], "entity_type", "full").join(matched, "entity_type", "left").na.fill(0)
    shares = [
        F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0)).alias(f"{name}_{how}")
        for how, part in (("partial", "n_partial"), ("exact", "n_exact"), ("credit", "credit"))
        for name, whole in (("precision", "n_found"), ("recall", "n_true"))
    ]
    return all_types.select("entity_type", "n_found", "n_true", "n_partial", "n_exact", "credit", *shares)


def case_counts(cases: DataFrame, *by: str) -> DataFrame:
    """How many test cases each category has."""
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cases"))
