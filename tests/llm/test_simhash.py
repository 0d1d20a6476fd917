"""SimHash against brute force over all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import simhash
from cloakwork.llm.components import components
from cloakwork.sources.tables import table


def brute_fingerprint(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").encode().decode().translate(
        {i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values, ids):
    root = list(range(len(values)))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(np.array(values, np.uint64) ^ np.uint64(values[i])) <= 3)
        low = {root[j] for j in near} | {root[i]}
        root = [min(low) if r in low else r for r in root]
    least = {}
    for r, i in zip(root, ids):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in root]


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents").toPandas().sort_values("doc_id")
    want = [brute_fingerprint(t) for t in docs.text]
    got = simhash.near_duplicates(table(spark, tiny, "documents")).toPandas().sort_values("doc_id")
    assert [int(x, 16) for x in got.fingerprint] == want
    assert got.component_id.tolist() == brute_roots(want, docs.doc_id.tolist())


def test_links_in_crowds_and_chains(spark):
    rnd = random.Random(5)
    values = [rnd.getrandbits(64) for _ in range(120)]
    for seed in values[:25]:  # chains of small steps, and crowds around one value
        here = seed
        for _ in range(6):
            for bit in rnd.sample(range(64), rnd.randint(1, 3)):
                here ^= 1 << bit
            values.append(here)
        values += [seed ^ (1 << bit) for bit in rnd.sample(range(64), 3)]
    values += [values[0] ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    values = sorted(set(values))
    ids = list(range(len(values)))
    frame = spark.createDataFrame(pd.DataFrame({"fp": np.array(values, np.uint64).view(np.int64)}))
    want = brute_roots(values, ids)
    for cell in (simhash.CELL, 40):
        roots = {r.node: r.root for r in components(simhash.links(frame, cell)).collect()}
        signed = np.array(values, np.uint64).view(np.int64).tolist()
        groups = {}
        for value, label in zip(signed, want):
            groups.setdefault(roots.get(value, value), set()).add(label)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_anchor_covering():
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 2**64, 500, dtype=np.uint64)
    other = fps.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rnd.integers(0, 64, 500, dtype=np.uint64)
    (ra, a), (rb, b) = simhash.anchors(fps), simhash.anchors(other)
    left, right = [{} for _ in fps], [{} for _ in fps]
    for rows, codes, into in ((ra, a, left), (rb, b, right)):
        for r, c in zip(rows.tolist(), codes.tolist()):
            into[r][c] = True
    assert all(x.keys() & y.keys() for x, y in zip(left, right))
    assert max(map(len, left)) <= 32


def test_components_of_a_long_path(spark):
    path = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in components(path).collect()} == {(i, 0) for i in range(1, 41)}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one", "x"), (4, "one", "x"), (None, "one", "x"), (5, "ONE", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted((r.doc_id or 0, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, False, 4), (1, True, 1), (2, True, 1), (3, True, 1), (4, False, 4), (4, False, 4), (5, False, 4)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 4, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [1, 2, 3, 4, 200_000])
def test_lengths(words):
    text = " ".join(f"W{i % 977}" for i in range(words))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_one_row_of_each_component(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(None, text["a"], 1)] * 3 + [(None, text["a"].upper(), 1)]  # null ids only
    rows += [(None, text["b"], 2), (None, text["b"].title(), 2), (7, text["b"], 2), (9, text["b"], 2)]
    rows += [(5, text["c"], 3)] * 4 + [(6, text["c"], 3)]
    rows += [(7, text["c"], 3), (8, text["d"], 4), (None, None, 5), (None, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = sorted((r.part, r.doc_id) for r in simhash.keep_one(docs, repeated=False).collect())
    assert got == [(1, None), (2, 7), (3, 5), (4, 8), (5, None)]
    got = sorted((r.part, r.doc_id) for r in simhash.keep_one(docs).collect())
    assert got == [(1, None), (2, 7), (3, 5), (3, 5), (3, 5), (3, 5), (4, 8), (5, None)]
