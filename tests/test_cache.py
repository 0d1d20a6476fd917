"""Findings kept across runs."""

from pyspark.sql import functions as F

from cloakwork.operators import cache, detect
from cloakwork.sources.rules import default_rules, without_rules

TEXTS = [f"write to user{i}@example.com or 10.0.0.{i}" for i in range(10)] + ["nothing here", "", None]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "ord", "start", "end", "value").collect()), key=repr)


def test_only_new_texts_are_matched(spark, tmp_path):
    root = str(tmp_path / "cache")
    made = lambda ids: spark.createDataFrame([(i, TEXTS[i % len(TEXTS)], "x") for i in ids], "doc_id long, text string, _hash string")
    first, every = made([*range(9), 11]), made([*range(26), 5])
    found, n = cache.detect_cached(first, root, "a")
    assert n == 10 and rows_of(found) == rows_of(detect.candidate_spans(first))
    found, n = cache.detect_cached(every, root, "b")
    # one more address and "nothing here"; null and empty texts are one text, seen before
    before = rows_of(found)
    assert n == 2 and before == rows_of(detect.candidate_spans(every))
    again, n = cache.detect_cached(every, root, "b")  # repeated under its name
    assert n == 2 and rows_of(again) == before
    assert cache.detect_cached(every, root, "c")[1] == 0
    assert cache.detect_cached(every.limit(0), root, "d")[1] == 0
    fewer = without_rules(default_rules(), [("EMAIL_ADDRESS", "quoted")])
    found, n = cache.detect_cached(every, root, "e", rules=fewer)
    assert n == 12 and rows_of(found) == rows_of(detect.candidate_spans(every, rules=fewer))
    cache.forget(spark, root)
    assert cache.detect_cached(first, root, "f")[1] == 10


def test_runs_at_a_time_and_unfinished_runs(spark, tmp_path):
    root = str(tmp_path / "cache")
    df = spark.createDataFrame([(i, TEXTS[i]) for i in range(12)], "doc_id long, text string")
    cache.detect_cached(df, root, "a")
    part = f"{root}/rules={cache.version()}"
    spark.read.schema(cache.SCHEMA).parquet(f"{part}/run=a").write.parquet(f"{part}/run=b")  # the same texts twice
    spark.createDataFrame([("x", None)], cache.SCHEMA).write.parquet(f"{part}/run=c")
    (tmp_path / f"cache/rules={cache.version()}/run=c/_SUCCESS").unlink()
    found, n = cache.detect_cached(df, root, "d")
    assert n == 0 and rows_of(found) == rows_of(detect.candidate_spans(df))
    assert found.agg(F.countDistinct("doc_id")).first()[0] == 10
