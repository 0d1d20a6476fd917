"""Snapshots and the log since against a full replay, at every day and with odd sessions."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import compaction, vault

START = datetime(2024, 3, 1)


def made(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(500):
        ts = START + timedelta(seconds=rng.randrange(6 * 86400))
        if rng.random() < 0.2:  # close to midnight
            ts = ts.replace(hour=0, minute=0, second=0) + timedelta(seconds=rng.choice([-20_000, -2, -1, 0, 1, 5000]))
        op = rng.choice(["put", "extend", "extend", "extend", "delete"])
        session = rng.choice(["a", "b", "c", "d", None])
        if op == "delete":
            rows.append((session, op, i, ts, None, None, None))
        for k, token in enumerate(rng.sample("PQRSTU", rng.randrange(3)) if op != "delete" else []):
            rows.append((session, op, i, ts, k, token, f"{token}{i}"))
    return spark.createDataFrame(rows, "session_id string, op string, op_id bigint, ts timestamp, ord int, token string, value string")


def rows_of(df):
    return sorted((r.session_id, r.token, r.value, tuple(r.ord)) for r in df.filter("session_id is not null").collect())


def test_same_as_full_replay(spark, tmp_path):
    log, root, ttl = made(spark, 1), str(tmp_path / "v"), 30_000
    compaction.append(log.filter("op_id % 2 = 0"), root)
    compaction.append(log.filter("op_id % 2 = 1"), root)
    checked = 0
    for n in (1, 2, 4, 6):
        day = date(2024, 3, 1) + timedelta(days=n)
        compaction.compact(spark, root, day, ttl)
        for seconds in (0, 40_000):
            as_of = F.lit(datetime(day.year, day.month, day.day) + timedelta(seconds=seconds)).cast("timestamp")
            got = rows_of(compaction.current(spark, root, as_of, day, ttl))
            assert got == rows_of(vault.current(log, as_of, ttl))
            checked += len(got)
        assert compaction.retire(spark, root, day) >= 1
    assert checked > 20 and compaction.snapshots(spark, root) == [date(2024, 3, 7)]


def test_reads_touch_the_snapshot_and_later_days_only(spark, tmp_path):
    log, root = made(spark, 3), str(tmp_path / "v")
    compaction.append(log, root)
    compaction.compact(spark, root, date(2024, 3, 4), 30_000)
    assert compaction.snapshots(spark, root) == [date(2024, 3, 4)]
    *_, since, base = compaction._since(spark, root, date(2024, 3, 5))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = since._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert base == date(2024, 3, 4) and "PartitionFilters: [isnotnull(day" in plan and ">= 2024-03-04" in plan
    days = {r.day for r in since.select("day").distinct().collect()}
    assert days and min(days) >= date(2024, 3, 4)
    # a moment before the snapshot is answered from the whole log
    as_of = F.lit(datetime(2024, 3, 3)).cast("timestamp")
    assert rows_of(compaction.current(spark, root, as_of, date(2024, 3, 3), 30_000)) == rows_of(vault.current(log, as_of, 30_000))
    with pytest.raises(ValueError):
        compaction.retire(spark, root, date(2024, 3, 5))


def test_an_unfinished_snapshot_is_not_read(spark, tmp_path):
    log, root = made(spark, 4), str(tmp_path / "v")
    compaction.append(log, root)
    compaction.compact(spark, root, date(2024, 3, 3), 30_000)
    (tmp_path / "v/snapshot/tokens/day=2024-03-05").mkdir(parents=True)
    assert compaction.snapshots(spark, root) == [date(2024, 3, 3)]
