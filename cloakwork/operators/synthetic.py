"""Stand-ins from the caller's own table of made-up values, of any size.

The table has ``entity_type, fake_value``. Its values are numbered within their type, and a finding takes the value whose number is a
hash of the finding's text modulo the type's count: always the same one, in every text and run, as long as the table stays. Findings
and table meet by type and number in a plain join, so the table is neither gathered nor sent to every task. Each distinct value is
looked up once, each distinct text put together once. A type without values in the table gets the constants of ``functions.masking``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.masking import replacement, spliced
from cloakwork.operators.mask import mask_table
from cloakwork.plans.skew import join_hot, running
from cloakwork.plans.stored import stored


def numbered_fakes(fakes: DataFrame) -> DataFrame:
    """``entity_type, number, fake_value``: distinct values, numbered from 0 within their type without a window over a whole type."""
    rows = fakes.select("entity_type", "fake_value").filter("entity_type is not null and fake_value is not null").distinct()
    rows = stored(rows)  # both the running value and what lies before a bucket read them
    bucket = F.conv(F.substring(F.md5("fake_value"), 1, 3), 16, 10).cast("int")
    out = running(rows, ["entity_type"], bucket, [F.col("_bucket"), F.col("fake_value")], F.lit(1), "number")
    return out.select("entity_type", F.col("number").cast("long").alias("number"), "fake_value")


def fakes_for(values: DataFrame, fakes: DataFrame, salt: str = "") -> DataFrame:
    """``entity_type, value, fake_value`` for distinct ``entity_type, value``; null where the type has no values."""
    counts = fakes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("_n"))  # a row for each type
    digest = F.sha2(F.concat(F.lit(salt), F.col("value")), 256)
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    asked = values.join(counts, "entity_type", "left").withColumn("number", F.pmod(number, F.col("_n"))).drop("_n")
    return asked.join(fakes.hint("merge"), ["entity_type", "number"], "left").select("entity_type", "value", "fake_value")


def mask_with_fakes(df: DataFrame, fakes: DataFrame, text: str = "text", salt: str = "", **options) -> DataFrame:
    """``mask_table`` with every finding replaced by a value of ``fakes``; the token map is empty, as nothing can be restored."""
    masked = mask_table(df, text, **options)
    order = masked.columns
    # what is put in anew below is neither made nor written
    masked = stored(masked.drop("masked_text", "token_map").withColumn("_hash", F.sha2(F.col(f"`{text}`"), 256)))
    texts = masked.filter(F.size("entities_found") > 0).groupBy("_hash").agg(F.any_value("entities_found").alias("_found"))
    rows = stored(texts.select("_hash", F.posexplode("_found").alias("_i", "f")).select("_hash", "_i", "f.entity_type", F.col("f.text").alias("value")))
    known = stored(fakes_for(rows.select("entity_type", "value").distinct(), stored(numbered_fakes(fakes)), salt))
    constant = F.expr(
        f"element_at(transform(array(named_struct('entity_type', entity_type, 'text', value)), f -> {replacement('SYNTHETIC', salt)}), 1)"
    )
    found = join_hot(rows, known, ["entity_type", "value"]).withColumn("_fake", F.coalesce("fake_value", constant))
    lists = found.groupBy("_hash").agg(F.sort_array(F.collect_list(F.struct("_i", "_fake"))).alias("_fakes"))
    joined = join_hot(masked, stored(lists), ["_hash"], "left")
    pairs = F.expr(
        "zip_with(entities_found, coalesce(_fakes, cast(array() as array<struct<_i:int,_fake:string>>)), (f, x) -> named_struct('start', f.start, 'end', f.end, 'token', x._fake))"
    )
    done = joined.withColumn("_num", pairs).withColumn("masked_text", F.expr(spliced("_num", f"`{text}`")))
    none = F.expr("cast(array() as array<struct<token:string,value:string>>)")
    return done.withColumn("token_map", none).select(*[F.col(f"`{c}`") for c in order])
