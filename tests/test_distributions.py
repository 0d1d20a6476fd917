"""Quantile sketches, risk by distribution, and stand-ins from a large table."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import audit, synthetic
from cloakwork.operators.mask import mask_table


def test_merged_sketches_keep_their_promise(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i % 30, rng.lognormvariate(0, 2) if rng.random() < 0.7 else 0.0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "source string, day int, density double").withColumn("n_findings", (F.col("density") > 0).cast("long"))
    days = audit.density_sketches(df, "source", "day")
    for name, merged in (("of days", audit.merged_sketches(days, "source")), ("of weeks", audit.merged_sketches(audit.merged_sketches(days.withColumn("week", F.expr("day div 7")), "source", "week"), "source"))):
        for r in audit.density_at(merged, [0.01, 0.25, 0.5, 0.9, 0.99]).collect():
            own = [x for s, _, x in rows if s == r.source]
            assert r.n_texts == len(own)
            error = audit.SKETCH_ERROR * len(own) + 1
            assert sum(x < r.density for x in own) <= r.rank * len(own) + error, name
            assert sum(x <= r.density for x in own) >= r.rank * len(own) - error, name


def test_risk_by_distribution(spark):
    # few enough texts that the sketch holds them all
    rows = [("a", float(i), 1) for i in range(1, 101)] + [("a", 0.0, 0), (None, 5.0, 2), ("b", 0.0, 0)]
    df = spark.createDataFrame(rows, "source string, density double, n_findings long").withColumn("risk", F.lit("old"))
    sketches = audit.merged_sketches(audit.density_sketches(df, "source"), "source")
    got = {(r.source, r.density): r.risk for r in audit.risk_by_distribution(df, sketches, "source").collect()}
    assert len(got) == 103
    assert got["a", 0.0] == got["b", 0.0] == "none" and got["a", 1.0] == got["a", 80.0] == "low"
    assert got["a", 95.0] == "medium" and got["a", 100.0] == "high" and got[None, 5.0] == "high"
    assert audit.risk_by_distribution(df.limit(0), sketches.limit(0), "source").collect() == []


def test_fakes_of_a_large_table(spark):
    n = 100_000
    fakes = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.concat(F.lit(t[0]), "id").alias("fake_value")) for t in ("EMAIL_ADDRESS", "IP_ADDRESS")])).alias("f")).select("f.*")
    fakes = fakes.unionByName(fakes.limit(5)).unionByName(spark.createDataFrame([("PERSON", None), (None, "x")], "entity_type string, fake_value string"))
    numbered = synthetic.numbered_fakes(fakes)
    by_type = {r.entity_type: r for r in numbered.groupBy("entity_type").agg(F.count("*").alias("n"), F.max("number").alias("top"), F.countDistinct("number").alias("d")).collect()}
    assert set(by_type) == {"EMAIL_ADDRESS", "IP_ADDRESS"} and all((r.n, r.top, r.d) == (n, n - 1, n) for r in by_type.values())
    rows = [(i, f"mail u{i % 7}@mail.com from 10.1.2.{i % 5} on 123-45-6789", "x") for i in range(40)] + [(None, None, "x"), (3, "", "x"), (3, "nothing", "x"), (3, "nothing", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fake_value string")
    once = sorted(map(str, synthetic.mask_with_fakes(df, fakes, session="doc_id").select("doc_id", "masked_text", "session_id", "fake_value").filter("doc_id is not null").collect()))
    again = synthetic.mask_with_fakes(df.repartition(7), fakes.repartition(3), session="doc_id")
    assert once == sorted(map(str, again.select("doc_id", "masked_text", "session_id", "fake_value").filter("doc_id is not null").collect()))
    assert len({r.masked_text for r in again.filter("text like 'mail u1@%'").collect()}) == 5  # the address alone decides, and the two others
    shapes = {x for x in (r.masked_text for r in again.filter("text like 'mail%'").collect())}
    assert len(shapes) == 35 and all(s.startswith("mail E") and " from I" in s and "000-00-000" in s for s in shapes)
    assert sorted(r.masked_text or "" for r in again.filter("text is null or text not like 'mail%'").collect()) == ["", "", "nothing", "nothing"]
    assert again.columns == mask_table(df, session="doc_id").columns


def test_the_table_of_fakes_is_not_broadcast(spark):
    fakes = spark.range(1000).select(F.lit("A").alias("entity_type"), F.col("id").alias("number"), F.col("id").cast("string").alias("fake_value"))
    values = spark.range(10).select(F.lit("A").alias("entity_type"), F.col("id").cast("string").alias("value"))
    plan = synthetic.fakes_for(values, fakes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert synthetic.fakes_for(values, fakes).filter("fake_value is null").count() == 0
