"""What large inputs depend on: work dealt out over the cores, short digests, and the same results."""

import random

from pyspark.sql import functions as F
from second_opinion import candidates
from test_masking import SHAPES

from cloakwork.functions.detection import with_candidates
from cloakwork.functions.regex import to_java
from cloakwork.operators import audit, crypto, synthetic
from cloakwork.plans import derived
from cloakwork.plans.spread import PARTITIONS
from cloakwork.sources.rules import active_rules
from cloakwork.streaming import streams


def test_contacts_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%d", "id").alias("c_name")).coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    setting = spark.conf.get(PARTITIONS)
    spark.conf.unset(PARTITIONS)
    try:
        contacts = derived.contacts(spark, str(tmp_path))
        used = contacts.select(F.spark_partition_id().alias("p")).distinct().count()
        rows = {r.doc_id: r.text for r in contacts.collect()}
    finally:
        spark.conf.set(PARTITIONS, setting)
    assert used >= spark.sparkContext.defaultParallelism
    assert sorted(rows) == list(range(100)) and all(f"Customer#{i} " in text for i, text in rows.items())


def test_ascii_texts_match_as_python_does(spark):
    rng = random.Random(5)
    shapes = [s for s in SHAPES if s.isascii() and "\x01" not in s and "\x02" not in s]
    glue = [" ", "", "_", "x", "a(", ") ", "-", ".", "/", "\x1c", "\x0b", "+", "0", "7", " abcdefghijk1", "1abcdefghijk ", " the quick brown fox "]
    texts = ["".join(rng.choice(shapes) + rng.choice(glue) + rng.choice(glue) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    texts += ["".join(rng.choice("0123456789 -.()+/x_A") for _ in range(rng.randint(5, 90))) for _ in range(600)]
    assert all(t.isascii() for t in texts)
    rules = active_rules()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: {(s.start, s.end, s.seq) for s in r.c} for r in with_candidates(df, "text", rules, "c").select("doc_id", "c").collect()}
    names = {(r.entity_type, r.pattern): r.ord for r in rules}
    for i, text in enumerate(texts):
        assert got[i] == {(s, e, names[kind, name]) for s, e, _, kind, name in candidates(text)}, text


def test_ascii_spelling_has_no_costly_class():
    for rule in active_rules():
        spelled = to_java(rule.regex, rule.ignore_case, ascii_only=True)
        assert r"\p{" not in spelled and not spelled.startswith("(?="), rule


def test_folder_of_files_is_streamed_like_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"mail u{i}@example.com") for i in range(30)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for name in ("many", "one"):
        stream = streams.read_folder(spark, f"{tmp_path}/{name}", "documents")
        assert streams.drain(stream, f"{tmp_path}/run-{name}").select("doc_id").distinct().count() == 30


def test_rows_are_not_gathered_by_period(spark):
    rows = spark.range(50).select(
        F.lit("s").alias("session_id"), F.col("id").cast("string").alias("token"), F.lit("v").alias("value"), F.timestamp_seconds(F.col("id") % 2 * 86400).alias("ts")
    )
    keys = crypto.key_frame(spark, {"k": "b2xkLW1hc3Rlci1rZXktMzItYnl0ZXMtbG9uZy0tLS0="}, [0, 1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sealed = crypto.encrypt_values(rows, keys, "k")
        opened = crypto.decrypt_values(sealed, keys, ["k"])
        plan = opened._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert opened.filter("value = 'v'").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_partial_quality_finds_spans_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    spans = spark.createDataFrame([(i, "A", 0, 4) for i in range(20)], "doc_id long, entity_type string, start int, end int")
    out = audit.partial_quality(spans.mapInPandas(told, spans.schema), spans).first()
    assert (out.n_found, out.n_true, out.n_partial, out.n_exact) == (20, 20, 20, 20)
    assert ran.value == 20


def _tasks_used(spark, df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_texts_and_truth_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id", "concat('mail u', id, '@example.com') AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(100).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    setting = spark.conf.get(PARTITIONS)
    spark.conf.unset(PARTITIONS)
    try:
        cores = spark.sparkContext.defaultParallelism
        assert _tasks_used(spark, derived.documents(spark, str(tmp_path))) >= cores
        assert _tasks_used(spark, derived.contact_truth(spark, str(tmp_path))) >= cores
        spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(3 * cores).write.parquet(f"{tmp_path}/many/documents.parquet")
        plan = derived.documents(spark, f"{tmp_path}/many")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.set(PARTITIONS, setting)


def test_made_up_values_are_read_once_and_replaced_texts_not_made(spark, monkeypatch):
    ran, kept = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    fakes = spark.createDataFrame([("EMAIL_ADDRESS", f"p{i}@example.org") for i in range(50)], "entity_type string, fake_value string")
    stored = synthetic.stored
    monkeypatch.setattr(synthetic, "stored", lambda df: (kept.append(df.columns), stored(df))[1])
    df = spark.createDataFrame([(1, "mail a@b.de"), (2, "none"), (3, None)], "doc_id long, text string")
    out = synthetic.mask_with_fakes(df, fakes.mapInArrow(counted, fakes.schema), session="doc_id")
    assert out.columns == ["doc_id", "text", "masked_text", "entities_found", "token_map", "session_id"]
    texts = {r.doc_id: r.masked_text for r in out.collect()}
    assert texts[1].endswith("@example.org") and texts[2] == "none" and texts[3] is None
    assert ran.value == 50
    assert not any("masked_text" in columns for columns in kept)
