"""Interval joins of span tables and one-to-one matching against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import audit
from cloakwork.operators.spans import overlap_counts, overlapping_pairs
from cloakwork.plans.stored import stored

KIND = "doc_id long, entity_type string, start int, end int, seq long"


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Fails where a join would send a side to the driver, though every table here is far below the size up to which Spark does so."""
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(audit, "stored", lambda df: stored(planned(df)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    yield planned
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans), plans


def made(rng, n, docs, reach, longest):
    out = []
    for i in range(n):
        start = rng.randrange(reach)
        out.append((rng.choice(docs), rng.choice("AB"), start, start + rng.randrange(longest + 1), i))
    return out


def meet(x, y):
    return x[2] <= y[2] < x[3] or y[2] <= x[2] < y[3]


def test_pairs_once_each(spark):
    rng = random.Random(2)
    left, right = made(rng, 150, [1, 2, None], 400, 90), made(rng, 150, [1, 2, 3, None], 400, 90)
    left += left[:3] + [(1, "A", None, 5, 900)]
    for width in (1, 7, 64, 1000):
        pairs = overlapping_pairs(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), width=width)
        got = sorted((tuple(p.l), tuple(p.r)) for p in pairs.collect())
        want = [(x, y) for x in left for y in right if x[2] is not None and x[0] == y[0] and x[0] is not None and meet(x, y)]
        assert got == sorted(want)


def test_one_text_with_very_many_spans(spark):
    n = 100_000
    left = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 6).cast("int").alias("end"))
    right = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 10 + 5).cast("int").alias("start"), (F.col("id") * 10 + 12).cast("int").alias("end"))
    pairs = overlapping_pairs(left, right)
    assert pairs.count() == 2 * n - 1
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matching_one_to_one(spark):
    rng = random.Random(6)
    found, gold = made(rng, 160, [1, 2, 3], 300, 40), made(rng, 160, [1, 2, 3], 300, 40)
    chain = [(9, "A", 10 * i, 10 * i + 9 + (i % 4), 0) for i in range(12)]
    found, gold = found + chain, gold + [(9, "A", s + 4, e + 5, 0) for _, _, s, e, _ in chain]

    def share(x, y):
        return (min(x[3], y[3]) - max(x[2], y[2])) / (max(x[3], y[3]) - min(x[2], y[2]))

    pairs = sorted(
        (-share(x, y), x[2:], y[2:], x, y) for x in {r[:4] for r in found} for y in {r[:4] for r in gold} if x[:2] == y[:2] and meet(x, y)
    )
    want, used = [], set()
    for s, _, _, x, y in pairs:
        if ("f", x) not in used and ("g", y) not in used:
            used |= {("f", x), ("g", y)}
            want.append((*x, y[2], y[3], -s))
    f, g = spark.createDataFrame(found, KIND), spark.createDataFrame(gold, KIND)
    got = sorted(tuple(r) for r in audit.matched_spans(f, g).collect())
    assert got == sorted(want) and len(want) > 100
    quality = {r.entity_type: r for r in audit.partial_quality(f, g).collect()}
    for kind, r in quality.items():
        own = [w for w in want if w[1] == kind]
        assert (r.n_partial, r.n_exact) == (sum(w[-1] >= 0.5 for w in own), sum(w[-1] == 1 for w in own))
        assert r.recall_partial == r.n_partial / len({x[:4] for x in gold if x[1] == kind})
    empty = f.limit(0)
    assert audit.matched_spans(empty, g).collect() == []
    assert all(r.n_found == 0 and r.precision_exact == 0 for r in audit.partial_quality(empty, g).collect())


def test_agreement_broadcasts_no_spans(spark, no_broadcast):
    model = spark.createDataFrame([(1, "person", "PERSON", 0, 9), (2, "email", "EMAIL_ADDRESS", 3, 4)], "doc_id long, label string, entity_type string, start int, end int")
    rules = spark.createDataFrame([(1, "name", "PERSON", 0, 9), (1, "mail", "EMAIL_ADDRESS", 20, 30)], "doc_id long, pattern string, entity_type string, start int, end int")
    got = {tuple(r) for r in no_broadcast(audit.agreement(model, rules)).collect()}
    assert got == {("person", "PERSON", "name", 1, 1, 0, 1), ("email", None, None, 1, 0, 0, 0), (None, "EMAIL_ADDRESS", "mail", 1, 0, 0, 0)}


def test_overlap_counts_broadcasts_no_spans(spark, no_broadcast):
    df = spark.createDataFrame([(1, 0, 9, 0), (1, 3, 5, 1), (1, 20, 30, 2), (2, 3, 5, 3)], "doc_id long, start int, end int, seq int")
    got = {r.seq: r.overlaps for r in no_broadcast(overlap_counts(stored(df), chunk=4)).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 1}


def test_matching_broadcasts_no_spans(spark, no_broadcast):
    found = spark.createDataFrame([(1, "A", 0, 9), (1, "A", 5, 12), (2, "A", 3, 4)], "doc_id long, entity_type string, start int, end int")
    gold = spark.createDataFrame([(1, "A", 4, 9), (2, "B", 3, 4)], found.schema)
    got = [tuple(r) for r in no_broadcast(audit.matched_spans(found, gold)).collect()]
    assert got == [(1, "A", 0, 9, 4, 9, 5 / 9)]
