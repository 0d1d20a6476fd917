"""The coder: exact round trips, parallel decoding, damage found, size near the entropy."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakwork.llm import files, rans
from cloakwork.llm.registry import BYTES_50K
from cloakwork.plans.stored import work_folder
from cloakwork.sources.tables import table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=600), st.integers(1, 8))
def test_blocks(values, lanes):
    ids = np.array(values, np.uint32)
    coder = rans.Table.scaled(np.bincount(ids))
    assert int(coder.frequencies.sum()) == 1 << rans.BITS
    was, rans.LANES = rans.LANES, lanes
    try:
        assert rans.decode_block(rans.encode_block(ids, coder), len(ids), coder).tolist() == values
    finally:
        rans.LANES = was


def test_size_is_near_the_entropy():
    rnd = np.random.default_rng(0)
    ids = np.minimum(rnd.zipf(1.3, 1 << 20), 50_000).astype(np.uint32)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    entropy = -(p * np.log2(p)).sum() * len(ids) / 8
    data = rans.encode_block(ids, rans.Table.scaled(counts))
    assert len(data) < 1.02 * entropy + 8 * rans.LANES


def test_files(tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 1000)
    rnd = np.random.default_rng(1)
    docs = [(d, rnd.integers(0, 300, n).astype(np.uint32)) for d, n in enumerate([0, 1, 5, 999, 1000, 1001, 7, 3500, 2])]
    coder = rans.Table.scaled(np.bincount(np.concatenate([i for _, i in docs])))
    uri, tables = f"{tmp_path}/a.rans", f"{tmp_path}/f.bin"
    coder.save(tables)
    assert rans.write_file(uri, iter(docs), coder) == (9, sum(len(i) for _, i in docs))
    coder = rans.Table.load(tables)
    assert [(d, i.tolist()) for d, i in rans.read_documents(uri, coder)] == [(d, i.tolist()) for d, i in docs]
    # any block alone
    joined, (_, points) = np.concatenate([i for _, i in docs]), rans.read_index(uri)
    with rans.opened(uri) as file:
        for point in points[::-1]:
            first = int(point["first"])
            assert rans.read_block(file, point, coder).tolist() == joined[first : first + int(point["ids"])].tolist()
    data = bytearray(open(uri, "rb").read())
    for place in (20, len(data) - 40):
        broken = bytearray(data)
        broken[place] ^= 1
        open(f"{tmp_path}/b.rans", "wb").write(broken)
        with pytest.raises(ValueError):
            list(rans.read_documents(f"{tmp_path}/b.rans", coder))


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rans.round_trip(docs, BYTES_50K).collect())) == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (None, "no id", 2), (3, "", 3), (9, "twice", 4), (9, "twice", 4), (9, "x " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long")
    folder = work_folder(spark)
    out = sorted(rans.read_corpus(rans.write_corpus(docs, BYTES_50K, folder), folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 3, 5, 9, 9, 9] and [r.n_tokens for r in out][1:3] == [1, 1]
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    assert rans.round_trip(docs.limit(0), BYTES_50K).collect() == []


def test_count_rows_of_many_tasks_are_spread(spark, tiny, tmp_path, monkeypatch):
    docs = table(spark, tiny, "documents").repartition(40)
    docs.write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(files, "RANGE_BYTES", 1 << 14)
    many = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/docs")
    n = files.width(many)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = []
    real = rans.stored
    monkeypatch.setattr(rans, "stored", lambda df: kept.append(real(df)) or kept[-1])
    folder = work_folder(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        out = rans.read_corpus(rans.write_corpus(many, BYTES_50K, folder), folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, out)) == sorted(map(tuple, rans.round_trip(docs, BYTES_50K).collect()))
    seen = [r["count"] for r in kept[0].filter(f"part >= {n}").groupBy("part").count().collect()]
    assert len(seen) > 1 and max(seen) <= -(-sum(seen) // len(seen)) + 1
