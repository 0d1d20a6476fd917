"""Consistent weighted sampling: collision rates against generalised Jaccard, and the query against a plain loop."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cloakwork.llm import sampling
from cloakwork.sources.tables import table


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def shingles(text):
    words = text.encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


@pytest.mark.parametrize("seed", range(6))
def test_collision_rate_is_generalised_jaccard(seed):
    rnd = np.random.default_rng(seed)
    names = np.sort(rnd.integers(0, 2**64, 300, dtype=np.uint64))
    pair = []
    for _ in range(2):
        w = rnd.integers(0, 6, 300) * (rnd.random(300) < 0.8)
        pair.append({int(k): int(x) for k, x in zip(names, w) if x})
    want = jaccard(Counter(pair[0]), Counter(pair[1]))
    tables = sampling.Draws(4000, seed=seed)
    got = [tables.sample(np.array(sorted(p), np.uint64), np.array([p[k] for k in sorted(p)])) for p in pair]
    assert np.mean(got[0] == got[1]) == pytest.approx(want, abs=4 * (want * (1 - want) / 4000) ** 0.5)


def test_parts_of_long_texts_change_nothing(monkeypatch):
    rnd = np.random.default_rng(0)
    terms = np.unique(rnd.integers(0, 2**64, 3000, dtype=np.uint64))
    weights = rnd.integers(1, 4, len(terms))
    whole = sampling.draws().sample(terms, weights)
    monkeypatch.setattr(sampling, "_PART", 100)
    assert (sampling.draws().sample(terms, weights) == whole).all()


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    got = sorted(sampling.report(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    errors = []
    for i, (r, (_, text)) in enumerate(zip(got, rows)):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == sampling.shown(sampling.fingerprint(text.encode()))
        assert r.edited_fingerprint == sampling.shown(sampling.fingerprint(new.encode()))
        for near, other in ((r.near_edited, new), (r.near_next, after)):
            assert 0 <= near <= 1
            errors.append(near - jaccard(shingles(text), shingles(other)))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.2
    same = {}
    for r, (_, text) in zip(got, rows):
        assert same.setdefault(text, r.fingerprint) == r.fingerprint


def test_odd_rows(spark):
    rows = [(4, "b b b b b b", 0), (None, "first of all", 1), (1, None, 2), (2, " \n", 3), (3, "one", 4), (3, "one", 5), (9, "ä" * 50_001, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long")
    got = sorted(sampling.report(docs).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 9]
    assert [r.n_chars for r in got] == [12, 0, 2, 3, 3, 11, 50_001]
    assert got[1].near_next == 1.0 and got[2].near_next == 0.0 and got[3].near_next == 1.0
    last = "ä" * 25_001 + "first of all"
    assert got[-1].edited_sha256 == hashlib.sha256(last.encode()).hexdigest()
    alone = sampling.report(docs.filter("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert sampling.report(docs.limit(0)).collect() == []
