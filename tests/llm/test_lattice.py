"""Lattice scores against enumerated segmentations and a plain computation of the whole query."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cloakwork.llm import lattice
from cloakwork.sources.tables import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(PATH)


def enumerated(word, pieces):
    """Probabilities of all segmentations below ``first`` and ``further``, with the counts of their pieces."""
    first = dict(zip(pieces.first.pieces, np.exp(pieces.first.log)))
    further = dict(zip(pieces.further.pieces, np.exp(pieces.further.log)))
    out = []

    def go(at, p, used):
        if at == len(word):
            out.append((p * math.exp(pieces.stop), used))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in further:
                go(end, p * further[word[at:end]], [*used, word[at:end]])
        if at < len(word):
            raw = word[at].encode()
            go(at + 1, p * math.prod(math.exp(pieces.byte[b]) for b in raw), used)

    for end in range(len(word) + 1):
        if word[:end] in first:
            go(end, first[word[:end]], [("first", word[:end])])
    return out


WORDS = ["", "a", "the", "thing,", "ñandú", "été", "日本", "x1y2", "!!", "😀a"]


def test_marginals_are_sums_over_all_segmentations(pieces):
    counts = [np.zeros(len(pieces.first.log)), np.zeros(len(pieces.further.log)), np.zeros(256)]
    got = lattice.marginals(WORDS, pieces, counts)
    want = Counter()
    for word, log in zip(WORDS, got):
        ways = enumerated(word, pieces)
        total = sum(p for p, _ in ways)
        assert log == pytest.approx(math.log(total), abs=1e-9)
        for p, used in ways:
            for piece in used:
                want[piece] += p / total
    for piece, n in want.items():
        own = counts[0][pieces.first.number[piece[1]]] if isinstance(piece, tuple) else counts[1][pieces.further.number[piece]]
        assert own == pytest.approx(n, abs=1e-9)
    assert counts[0].sum() == pytest.approx(len(WORDS))


def test_one_by_one_and_together_agree(pieces):
    words = [*WORDS, "abc" * 15, "ñ" * 40, "the" * 300, "日" * 60]
    one, all_ = ([np.zeros(len(pieces.first.log)), np.zeros(len(pieces.further.log)), np.zeros(256)] for _ in range(2))
    assert lattice.marginals(words, pieces, all_) == pytest.approx([lattice._scalar(w, pieces, one) for w in words])
    for a, b in zip(one, all_):
        assert a == pytest.approx(b, abs=1e-8)


def test_fitting_raises_the_likelihood(spark):
    words = [f"{a}{b}{c}" for a in ("th", "er", "sta") for b in ("on", "ing", "ez") for c in ("", "ly", "re,")]
    frame = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    sums = [lattice.marginals(words, lattice._fitted(frame, lattice.Pieces(PATH), len(words), r)).sum() for r in range(4)]
    assert sums == sorted(sums) and sums[3] > sums[0] + 10


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = sorted(lattice.scores(docs, PATH).collect(), key=lambda r: r.doc_id)
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    out = {d for d, _ in texts if zlib.crc32(str(d).encode()) % 5 == 1}
    counts = Counter(w for d, words in texts if d not in out for w in words)
    ends = len(texts) - len(out)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    known = sorted(counts)
    frame = spark.createDataFrame([(w,) for w in known], "word binary")
    fitted = lattice._fitted(frame, lattice.Pieces(PATH), len(known), lattice.ROUNDS)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    every = sorted({w for _, words in texts for w in words})
    sub = dict(zip(every, lattice.marginals([w.decode() for w in every], fitted)))
    left = math.log((discount * v + 1) / (n + 1))

    def log(w, c, lattice_log):
        p = math.exp(left + lattice_log) + (max(0, c - discount) / (n + 1) if c else 0)
        return math.log10(p) if p else (left + lattice_log) / math.log(10)

    end = log(b"", ends, float(fitted.first.log[fitted.first.number[""]]) + fitted.stop)
    for r, (d, words) in zip(rows, texts):
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (d, d in out, len(words) + 1, n)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(sum(log(w, counts[w], sub[w]) for w in words) + end, rel=1e-9)


def test_probabilities_add_up(pieces):
    """Over all words of up to two letters from a small alphabet, with pieces cut down to it, mass stays below one."""
    letters = "abc"
    words = ["", *letters, *(a + b for a in letters for b in letters)]
    assert np.exp(lattice.marginals(words, pieces)).sum() < 1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "  ", "x"), (None, "One two", "y"), (3, "one ONE", "y"), (3, "one ONE", "y"), (4, "z" * 3000, None), (11, "new words", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = sorted(lattice.scores(docs, PATH).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 2), (11, 3)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got) and got[3] == got[4]
    assert got[1].score == got[2].score
    assert lattice.scores(docs.limit(0), PATH).collect() == []
    # nothing to learn from
    assert all(math.isfinite(r.score) for r in lattice.scores(docs, PATH, folds=1, fold=0).collect())
