"""Repeated strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm import runs, suffixes
from cloakwork.llm.texts import word_hashes
from cloakwork.sources.tables import table


def brute(docs, depth):
    """docs: sorted (id, bytes). Per document the covered flags of its bytes."""
    first, out = {}, []
    for d, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i : i + depth]
            if first.setdefault(w, (d, i)) < (d, i):
                gone[i : i + depth] = b"\1" * depth
        out.append((d, raw, gone))
    return out


def digest(d, raw, gone):
    kept = bytes(c for c, g in zip(raw, gone) if not g)
    spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
    return d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_whole_table(spark, tiny):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in table(spark, tiny, "documents").collect())
    want = [digest(*x) for x in brute(docs, suffixes.DEPTH)]
    got = suffixes.report(table(spark, tiny, "documents")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 0


def test_small_texts(spark):
    rnd = random.Random(2)
    made = ["", "a" * 400, "ab" * 150, "é" * 90, None]
    for _ in range(60):
        made.append("".join(rnd.choice(["ab", "ba", "é", "x", "the quick "]) for _ in range(rnd.randint(0, 120))))
    made += [made[9] + made[10], made[11][3:] + "zz" + made[12], made[20] * 3]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for depth in (100, 20, 33):
        want = [digest(*x) for x in brute([(i, (t or "").encode()) for i, t in enumerate(made)], depth)]
        got = suffixes.report(frame, depth=depth).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_crowded_cores(spark, monkeypatch):
    monkeypatch.setattr(runs, "CROWD", 30)
    monkeypatch.setattr(runs, "SAMPLED", 2)
    made = [f"{i:04d}" * 5 + "one passage that every one of the documents holds, and not a word of it differs " * 2 for i in range(80)]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = [digest(*x) for x in brute([(i, t.encode()) for i, t in enumerate(made)], 40)]
    got = suffixes.report(frame, depth=40).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_remove_keeps_columns_rows_and_characters(spark):
    passage = "éàüñçöêíúâôîëï and so on"
    # the last byte of both first letters is the same, and so part of the repeated string
    rows = [(1, "ù" + passage + "!", 1, 10, "p"), (2, "й" + passage, 2, 20, "q"), (2, "й" + passage, 2, 20, "q"), (None, None, None, 30, "r"), (3, "", 3, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d long, n_chars long, parts string")
    out = suffixes.remove(docs, depth=30)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text, r.d, r.n_chars, r.parts) for r in out.collect())
    assert got == [(0, None, None, None, "r"), (1, "ù" + passage + "!", 1, 26, "p"), (2, "й", 2, 1, "q"), (2, "й", 2, 1, "q"), (3, "", 3, 0, None)]
    assert suffixes.remove(docs.limit(0)).collect() == [] and suffixes.report(docs.limit(0)).collect() == []


def test_null_id_and_repeated_rows(spark):
    text = "x" * 10 + "".join(chr(97 + i % 23) for i in range(150))
    rows = [(None, text), (5, text), (5, text), (5, "other " + text), (9, text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixes.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # of 160 bytes with period 23 from the tenth on, the id-less row keeps its first strings
    own = sum(digest(*brute([(0, text.encode())], 100)[0])[2:3])
    assert got == [(0, own), (5, 160), (5, 160), (5, 160), (9, 160)]


def test_many_rows_without_id_and_a_row_repeated_often(spark):
    """Neither shares its runs with the other rows of its id."""
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    rows = [(None, f"{i:06d}" + text) for i in range(5_000)] + [(7, text)] * 5_000 + [(None, "")] * 5_000
    got = suffixes.report(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = {(r.doc_id, r.n_removed): r["count"] for r in got.groupBy("doc_id", "n_removed").count().collect()}
    assert counts == {(None, 0): 10_000, (7, len(text)): 5_000}


def test_a_very_long_text(spark):
    rnd = random.Random(4)
    raw = "".join(rnd.choice("abcdefgh") for _ in range(400_000))
    docs = [(1, raw), (2, "x" + raw[1000:300_000] + "y"), (3, raw[5:205] * 3)]
    want = [digest(*x) for x in brute([(d, t.encode()) for d, t in docs], 100)]
    got = suffixes.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=200), st.integers(1, 9))
def test_runs_cover_each_window_once(values, span):
    cores = np.array([v * 0x9E3779B97F4A7C15 % 2**64 for v in values], np.uint64)
    core, first, n, lead = runs.runs(cores, span)
    assert np.concatenate([np.arange(f, f + k) for f, k in zip(first, n)] or [[]]).tolist() == list(range(max(0, len(values) - span + 1)))
    for c, f, k, far in zip(core, first, n, lead):
        for w in range(f, f + k):
            assert c == min(cores[w : w + span]) and w <= f + far < w + span and cores[f + far] == c


def test_stretches(monkeypatch):
    rnd = np.random.default_rng(1)
    raw = rnd.integers(97, 101, 5000, dtype=np.uint8).tobytes()
    whole = runs.byte_units(100, 32).runs(raw)
    monkeypatch.setattr(runs, "STRETCH", 512)
    core, first, n, _ = runs.byte_units(100, 32).runs(raw)
    spread = lambda c, f, k: dict(zip(np.concatenate([np.arange(a, a + b) for a, b in zip(f, k)]), np.repeat(c, k)))
    assert spread(*whole[:3]) == spread(core, first, n)


@pytest.mark.parametrize("raw", [b"", b" \t\n", b"one", b" a  bb\x0bccc\x1cd \xc3\xa9\n", b"w " * 3000])
def test_word_places(raw):
    starts, ends, h = word_hashes(raw)
    words = raw.split() if b"\x1c" not in raw else [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", raw)]
    assert [raw[a:b] for a, b in zip(starts, ends)] == words
    assert len({*h.tolist()}) == len({*words})
