"""Mixing against the rules it must follow, and apportionment against the plain highest-quotient loop."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm import mixing
from cloakwork.sources.tables import table


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=12), st.integers(0, 120))
def test_highest_quotients(pairs, seats):
    votes, most = np.array([v for v, _ in pairs], float), np.array([m for _, m in pairs])
    got, want = mixing.sainte_lague(votes, seats, most), np.zeros(len(pairs), int)
    for _ in range(seats):
        quotients = [(v / (2 * w + 1), -i) for i, (v, w, m) in enumerate(zip(votes, want, most)) if w < m and v > 0]
        if not quotients:
            break
        want[-max(quotients)[1]] += 1
    assert got.tolist() == want.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=10))
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(g <= 3 * n + 1e-6 for g, n in zip(got, sizes))
    units = [g / w for g, w, n in zip(got, weights, sizes) if g < 3 * n - 1e-6]
    assert not units or max(units) == pytest.approx(min(units))
    # a source that stopped would have got more
    assert all(g / w <= min(units) + 1e-6 for g, w in zip(got, weights)) if units else True


def check(rows, words):
    """The contract of the query over rows of ``choose``."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    goal = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for s, n, g in zip(names, sizes, goal):
        assert all(r.source_size == n and r.target == pytest.approx(g) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - g) <= 2 * mixing.BLOCK
        for r in by[s]:
            assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] + sum(p.high - p.low for p in r.parts)
            assert all(0 <= p.low < p.high <= r["size"] for p in r.parts)
    assert Counter((r.doc_id, r["size"]) for r in rows) == words


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = mixing.choose(docs).collect()
    check(rows, Counter((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect()))
    again = mixing.choose(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_many_shards(spark, tiny, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 300)
    docs = table(spark, tiny, "documents")
    rows = mixing.choose(docs).collect()
    by, goal = defaultdict(int), {}
    for r in rows:
        by[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    shards = -(-sum(r["size"] for r in rows) // (mixing.BLOCK * 300))
    assert shards > 3 and all(abs(by[s] - goal[s]) <= (shards + 1) * mixing.BLOCK for s in by)


def test_many_rows_without_id(spark, monkeypatch):
    """Rows without an id are dealt out by their texts, and shards follow the rows, too, where texts are short or empty."""
    monkeypatch.setattr(mixing, "SHARD", 500)
    rows = [(None, f"only {i}", "a") for i in range(4000)] + [(i, None, "b") for i in range(4000)] + [(i, "b " * 40, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen, inner = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df: seen.append(inner(df)) or seen[-1])
    got = mixing.choose(docs).collect()
    shards = -(-len(rows) // 500)
    shard = mixing.F.conv(mixing.F.substring("place", 9, 8), 16, 10).cast("long") % shards
    most = max(r["count"] for r in seen[0].groupBy("source", shard).count().collect())
    assert shards == 17 and most < 2 * len(rows) / shards
    by, goal = defaultdict(int), {}
    for r in got:
        by[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(by[s] - goal[s]) <= (shards + 1) * mixing.BLOCK for s in by)


def test_odd_rows_and_mixed_documents(spark):
    text = " ".join(f"w{i}" for i in range(900))
    rows = [(1, text, "a", 5, "x"), (2, None, "a", 0, "x"), (3, "one two", "b", 0, "y"), (3, "one two", "b", 0, "y"), (None, text, None, 0, "z")]
    rows += [(10 + i, text[: 400 + 3 * i], "c", 1, None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, size string")
    chosen = mixing.choose(docs).collect()
    check(chosen, Counter((r[0], len((r[1] or "").split())) for r in rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in chosen:
        want[r.doc_id, r.source] += r.taken
    assert got == +want
    assert mixing.choose(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_equal_rows_take_their_own_picks(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, "a", i % 7) for i in range(60)] + [(4, text, "a", i % 7) for i in range(60)]
    rows += [(100 + i, text, s, 0) for i in range(60) for s in "bc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kind int").repartition(5)
    want, goal = Counter(), {}
    for r in mixing.choose(docs).collect():
        want[r.doc_id, r.source] += r.taken
        goal[r.source] = r.target

    def taken(docs):
        return Counter((r.doc_id, r.source, r.kind, r.text) for r in mixing.mix(docs).collect())

    first, got, by = taken(docs), Counter(), Counter()
    for (d, s, _, t), n in first.items():
        got[d, s] += n * len(t.split())
        by[s] += n * len(t.split())
    assert got == +want
    assert all(abs(by[s] - g) <= 2 * mixing.BLOCK for s, g in goal.items())
    assert taken(docs.repartition(3)) == first
