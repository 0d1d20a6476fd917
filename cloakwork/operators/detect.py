"""Detectors: rule matches as rows, the model hook, labels, thresholds and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.detection import with_candidates
from cloakwork.plans.skew import join_hot
from cloakwork.sources.labels import entity_type_of
from cloakwork.sources.rules import MODEL_THRESHOLD, Rule, active_rules, rules_frame

Predict = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]


def candidate_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """Every match of every rule, one row each:
    ``key, ord, entity_type, pattern, start, end, score, value``."""
    rules = active_rules(rules)
    return _span_rows(_span_arrays(df, key, text, rules), key, rules)


def _span_arrays(df: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    return with_candidates(df.select(key, text), text, rules, "_cand").select(
        key,
        F.expr(
            f"""transform(_cand, s -> named_struct('ord', s.seq, 'start', s.start, 'end', s.end, 'score', s.score,
                'value', substring(`{text}`, s.start + 1, s.end - s.start)))"""
        ).alias("_spans"),
    )


def _span_rows(arrays: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    rows = arrays.select(key, F.explode_outer("_spans").alias("s")).select(key, "s.*").filter("ord is not null")
    # a row for each rule: every rule is an expression of the plan as well, so they are few
    names = F.broadcast(rules_frame(arrays.sparkSession, rules).select("ord", "entity_type", "pattern"))
    return rows.join(names, "ord").select(key, "ord", "entity_type", "pattern", "start", "end", "score", "value")


def detect_type(
    df: DataFrame, entity_type: str, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """Matches of the rules of one entity type."""
    spans = candidate_spans(df, key, text, active_rules(rules, [entity_type]))
    return spans.select(key, "pattern", "start", "end", "value")


def detect_distinct(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """``candidate_spans``, matching each distinct text once; worth its shuffle where copies abound.

    Texts are brought together by their hash, with partial aggregation, and go through the rules there; the findings
    go back to all copies, however many one text has. Keys may repeat.
    """
    rules = active_rules(rules)
    hashed = df.select(F.col(key), F.col(text).alias("_text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_hash"))
    texts = hashed.groupBy("_hash").agg(F.any_value("_text").alias("_text"))
    found = _span_arrays(texts, "_hash", "_text", rules)
    copies = join_hot(hashed.drop("_text"), found, ["_hash"])
    return _span_rows(copies.select(key, "_spans"), key, rules)


def model_spans(
    df: DataFrame, load: Callable[[], Predict], key: str = "doc_id", text: str = "text", failures: Accumulator | None = None
) -> DataFrame:
    """Findings of an external model: ``key, label, start, end, score``.

    ``load`` is called once per task and gives a function from a list of texts to a list of
    ``(label, start, end, score)`` tuples for each. Blank texts are not shown to it. A batch on which it fails is tried text by text;
    a text on which it fails then has no model findings, rules still apply to it, and ``failures`` counts it.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("label", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        predict = load()

        def one(value: str) -> list:
            try:
                return predict([value])[0]
            except Exception:  # noqa: BLE001  any failure of a foreign model
                if failures is not None:
                    failures.add(1)
                return []

        for batch in batches:
            shown = batch[batch[text].fillna("").str.strip() != ""]
            try:
                spans = predict(shown[text].tolist())
            except Exception:  # noqa: BLE001  one bad text must not cost the others theirs
                spans = [one(value) for value in shown[text]]
            found = [(ident, *span) for ident, own in zip(shown[key], spans) for span in own]
            yield pd.DataFrame(found, columns=[key, "label", "start", "end", "score"])

    return df.select(key, text).mapInPandas(run, schema)


def map_labels(spans: DataFrame) -> DataFrame:
    """Add the ``entity_type`` of each ``label``."""
    return spans.withColumn("entity_type", entity_type_of(F.col("label")))


def above_threshold(spans: DataFrame, threshold: float = MODEL_THRESHOLD) -> DataFrame:
    return spans.filter(F.col("score") >= threshold)


def luhn_valid(spans: DataFrame, value: str = "value") -> DataFrame:
    """Spans whose digits pass the Luhn check."""
    return spans.filter(F.expr(f"luhn_check(regexp_replace(`{value}`, '[^0-9]', ''))"))


def with_external(
    df: DataFrame, spans: DataFrame, key: str = "doc_id", threshold: float | None = None, out: str = "external"
) -> DataFrame:
    """Attach a table of external spans (``key, label, start, end, score`` and optionally ``rank``) to
    its texts, as the array column ``analyze`` takes.

    The spans of a text lie inside that text, which is one row already, so the array is of its order.
    Spans are gathered before they meet the texts, so only one row per text joins.
    """
    if threshold is not None:
        spans = above_threshold(spans, threshold)
    order = [F.col("rank")] if "rank" in spans.columns else []
    entry = F.struct(
        *order, F.col("start"), F.col("end"), entity_type_of(F.col("label")).alias("entity_type"), F.col("score")
    )
    gathered = spans.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_ext"))
    shaped = F.expr(
        """transform(_ext, e -> named_struct('entity_type', e.entity_type, 'start', e.start, 'end', e.end,
            'score', e.score))"""
    )
    return df.join(gathered, key, "left").withColumn(out, shaped).drop("_ext")
