"""Span tables: one row per span, ``key, start, end, score, seq`` and more.

The same work as the per-text arrays of ``functions.overlap`` for spans that come as rows. Long texts
are cut at fixed offsets, so one text with very many spans does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.functions.detection import SPAN
from cloakwork.functions.overlap import island_numbers, kept_places
from cloakwork.plans.skew import join_large, running
from cloakwork.plans.stored import stored

CHUNK = 65_536


def _stretches(spans: DataFrame, key: str, chunk: int) -> DataFrame:
    """``key, _run, _all``: the spans of each text, sorted, in arrays that no span reaches out of.

    Spans are gathered by ``chunk`` characters of a text, where they are and with partial aggregation; a chunk that an earlier span reaches
    into then joins the one before it. Spans without a text or a start have no place and are left out.
    """
    details = [c for c in spans.columns if c not in (key, "start", "end", "seq", "score")]
    score = F.col("score") if "score" in spans.columns else F.lit(0.0).alias("score")
    entry = F.struct("start", "end", "seq", score, F.struct(F.lit(0), *details).alias("d"))
    placed = spans.filter(F.col(key).isNotNull() & F.col("start").isNotNull())
    pieces = placed.groupBy(key, F.floor(F.col("start") / chunk).alias("_bucket")).agg(
        F.collect_list(entry).alias("_all"), F.min("start").alias("_first"), F.max("end").alias("_reach")
    )
    by_text = Window.partitionBy(key).orderBy("_bucket")
    reached = F.max("_reach").over(by_text.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_first")
    pieces = pieces.withColumn("_begins", F.when(reached, 0).otherwise(1))
    pieces = pieces.withColumn("_run", F.sum("_begins").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(key, "_run").agg(F.sort_array(F.flatten(F.collect_list("_all"))).alias("_all"))


_BARE = f"transform(_all, a -> cast(named_struct('start', a.start, 'end', a.end, 'seq', a.seq, 'score', a.score) as {SPAN}))"


def _before(stretches: DataFrame, key: str, islands: str) -> DataFrame:
    """Add ``_before``: how many islands the text has in earlier stretches."""
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return stretches.withColumn("_before", F.coalesce(F.sum(F.expr(islands)).over(earlier), F.lit(0)))


def islands(spans: DataFrame, key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Add ``island``: spans connected by overlaps share a number, counted from 1 along the text."""
    out = _stretches(spans, key, chunk).withColumn("_island", island_numbers(F.expr(_BARE)))
    out = _before(out, key, "element_at(_island, -1) + 1")
    out = out.select(key, "_before", "_island", F.posexplode("_all").alias("_i", "s"))
    own = {c: f"s.`{c}`" for c in ("start", "end", "seq", "score")} | {key: f"`{key}`"}
    return out.select(*[F.col(own.get(c, f"s.d.`{c}`")).alias(c) for c in spans.columns], F.expr("_before + _island[_i] + 1").alias("island"))


def resolve_overlaps(spans: DataFrame, key: str = "doc_id", mode: str = "compat") -> DataFrame:
    """Kept spans with ``emit_pos``, their order within the island.

    Choices in one island do not depend on another, so each island is decided on its own.
    """
    details = [c for c in spans.columns if c not in (key, "start", "end", "seq", "score")]
    kept = _stretches(spans, key, CHUNK).withColumn("_places", kept_places(F.expr(_BARE), mode))
    kept = _before(kept, key, "element_at(_places, -1).island + 1")
    kept = kept.select(key, F.explode(F.expr("transform(_places, p -> named_struct('s', _all[p.at], 'island', _before + p.island + 1, 'pos', p.pos))")).alias("k"))
    return kept.select(
        key, "k.s.start", "k.s.end", "k.s.seq", "k.island", F.col("k.pos").alias("emit_pos"), "k.s.score", *[F.col(f"k.s.d.`{c}`").alias(c) for c in details]
    )


def overlap_counts(spans: DataFrame, key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Add ``overlaps``: how many spans of the text overlap this one, itself included.

    Counted without forming pairs: spans that begin before my end, less those that end by my start.
    """
    ident = [key, "start", "end", "seq"]
    points = spans.select(
        *ident,
        F.explode(
            F.array(
                F.struct(F.col("end").alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("begun"), F.lit(0).alias("ended")),
                F.struct(F.col("start").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("begun"), F.lit(0).alias("ended")),
                F.struct(F.col("end").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("begun"), F.lit(1).alias("ended")),
                F.struct(F.col("start").alias("at"), F.lit(2).alias("turn"), F.lit(0).alias("begun"), F.lit(0).alias("ended")),
            )
        ).alias("p"),
    ).select(*ident, "p.*")
    bucket = F.floor(F.col("at") / chunk)
    order = [F.col("at"), F.col("turn")]
    swept = running(points, [key], bucket, order, F.col("begun"), "n_begun")
    swept = running(swept, [key], bucket, order, F.col("ended"), "n_ended")
    counts = swept.groupBy(*ident).agg(
        (
            F.max(F.when(F.col("turn") == 0, F.col("n_begun"))) - F.max(F.when(F.col("turn") == 2, F.col("n_ended")))
        ).alias("overlaps")
    )
    return join_large(spans, counts, ident)


PAIR_WIDTH = 64


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = PAIR_WIDTH) -> DataFrame:
    """Every pair of a span of ``left`` and one of ``right`` in the same text that overlap, once: the columns of
    both as structs ``l`` and ``r``.

    Texts are cut into stretches of ``width`` characters, and a span has a row for each stretch it lies in; spans meet by text and
    stretch, and a pair counts where the later of the two begins. So a text with very many spans is spread over its stretches, and no
    span is held against one that is far from it. An empty span overlaps one that begins at or before it and ends behind it.
    """

    def rows(spans: DataFrame, name: str) -> DataFrame:
        first, last = F.expr(f"start div {width}"), F.expr(f"greatest(start, end - 1) div {width}")
        whole = F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias(name)
        return spans.filter("start is not null and end is not null").select(F.col(key).alias("_key"), F.explode(F.sequence(first, last)).alias("_at"), whole)

    both = join_large(rows(left, "l"), rows(right, "r"), ["_key", "_at"])
    meet = "(l.start <= r.start and r.start < l.end) or (r.start <= l.start and l.start < r.end)"
    return both.filter(meet).filter(f"_at = greatest(l.start, r.start) div {width}").select("l", "r")


def number_tokens(kept: DataFrame, key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Add ``n``: per text and type, counted from the end of the text."""
    return _count_back(kept, [key, "entity_type"], chunk, "n", 1)


def order_spans(kept: DataFrame, key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Add ``place``: 0 for the last span of the text, counting towards its beginning."""
    return _count_back(kept, [key], chunk, "place", 0)


def _count_back(kept: DataFrame, keys: list[str], chunk: int, out: str, first: int) -> DataFrame:
    bucket = -F.floor(F.col("start") / chunk)
    order = [F.col("start").desc(), F.col("island"), F.col("emit_pos")]
    # both the running value and what lies before a bucket read their input
    counted = running(stored(kept), keys, bucket, order, F.lit(1), out)
    return counted.withColumn(out, F.col(out) + first)
