"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import numpy as np

from cloakwork.llm import debruijn, runs
from cloakwork.sources.tables import table


def brute(docs, width):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, words in split:
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(docs, **more):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.report(docs, **more).collect())


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], debruijn.WIDTH)
    assert result(docs) == want and sum(w[2] for w in want) > 0


def made():
    rnd = random.Random(8)
    word = lambda k: f"w{rnd.randint(0, k)}"
    passages = [" ".join(word(50) for _ in range(n)) for n in (14, 30, 80, 200)]
    out = []
    for _ in range(70):
        parts = [" ".join(word(rnd.choice([2, 9, 400])) for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages).split()
            a = rnd.randint(0, len(p) // 2)
            parts.insert(rnd.randint(0, len(parts)), " ".join(p[a : a + rnd.randint(5, len(p))]))
        out.append("\n".join(parts))
    out += ["", None, "same " * 100, "same " * 90, "a b " * 60, "b a " * 60, out[3], out[4] + " and " + out[5]]
    rnd.shuffle(out)
    return list(enumerate(out))


def test_small_texts(spark):
    docs = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (13, 5, 2):
        assert result(frame, width=width) == brute(docs, width)


def test_crowded_cores(spark, monkeypatch):
    monkeypatch.setattr(runs, "CROWD", 20)
    monkeypatch.setattr(runs, "SAMPLED", 2)
    docs = made()
    assert result(spark.createDataFrame(docs, "doc_id long, text string"), width=6) == brute(docs, 6)


def test_a_long_passage_is_one_path(spark):
    passage = " ".join(f"p{i}" for i in range(3000))
    docs = [(1, "x y z " + passage + " end"), (2, "other words " + passage), (3, passage + " more"), (4, "nothing shared")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = debruijn.id_and_text(frame)
    spans = debruijn.repeated_spans(texts).collect()
    assert {r.first for r in spans} == {1} and {r.d for r in spans} == {2, 3}
    # one compact path for each occurrence, besides the single edges at its ends
    long_ = [r for r in spans if r.n > 1]
    assert len(long_) == 2 and all(r.n > 2900 for r in long_)
    split = {d: t.split() for d, t in docs}
    for r in long_:  # the source's place is kept, and both places hold the same words
        there = split[r.first][r.first_at : r.first_at + r.n + debruijn.WIDTH - 1]
        assert there == split[r.d][r.at : r.at + r.n + debruijn.WIDTH - 1]
        assert debruijn._witness(" ".join(there).encode()) == np.array([r.s1, r.s2], "<i8").tobytes()


def test_every_longer_span_has_a_source(spark):
    texts = debruijn.id_and_text(spark.createDataFrame(made(), "doc_id long, text string"))
    split = {d: (t or "").split() for d, t in made()}
    spans = debruijn.repeated_spans(texts, 5).collect()
    assert sum(r.n > 1 for r in spans) > 20
    for r in spans:
        if r.first_at is None:
            assert r.n == 1 and not (r.s1 or r.s2)
        else:
            assert split[r.first][r.first_at : r.first_at + r.n + 4] == split[r.d][r.at : r.at + r.n + 4]


def test_spans_that_differ_from_their_source_do_not_count():
    words = [b"w%d" % i for i in range(20)]
    seen = debruijn._hashes(debruijn._places(words), np.array([2, 3]), np.array([6, 6]), debruijn._witness)
    at, n = np.array([2, 2, 4, 18]), np.array([2, 2, 1, 1])
    s = np.stack([seen[0], seen[1], [0, 0], [0, 0]])
    assert debruijn.verified(words, at, n, s, 5).tolist() == [True, False, True, False]


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (5, "x " + text, 4), (9, text + " y", 5), (2, None, 6), (3, " \n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first long")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in debruijn.report(docs).collect())
    assert got == [(0, 40, 0), (2, 0, 0), (3, 0, 0), (5, 40, 40), (5, 40, 40), (5, 41, 40), (9, 41, 40)]
    assert debruijn.report(docs.limit(0)).collect() == []


def test_many_rows_without_id_and_a_row_repeated_often(spark):
    """Neither shares its runs: arrays are those of one text, and 20,000 copies of a row are no square of anything."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, f"a{i} b{i} " + text) for i in range(20_000)] + [(7, text)] * 20_000 + [(None, "")] * 20_000
    got = debruijn.report(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in got.groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert counts == {(None, 32, 0): 20_000, (7, 30, 30): 20_000, (None, 0, 0): 20_000}


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    long_ = " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(300_000))
    words = long_.split()
    docs = [(1, long_), (2, "new " + " ".join(words[1000:250_000]) + " end"), (3, " ".join(words[5:60]))]
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 13)
