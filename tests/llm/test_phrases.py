"""Phrase mining against a plain count, with failures of the sample, odd rows and cut texts."""

import random
import re
from collections import Counter

import pytest

from cloakwork.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, most):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, totals


def plain(rows, shape):
    counts, totals = plain_counts(rows, shape.words)
    by_lang = {}
    for (lang, w), a in counts.items():
        if len(w) < 2 or a < shape.least:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang.setdefault(lang, {})[w] = (-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]])
    out = []
    for lang, found in by_lang.items():
        inside = {v[i:j] for v in found for i in range(len(v)) for j in range(i + 1, len(v) + 1) if len(v[i:j]) < len(v) and v[i:j] in found and found[v][1] == found[v[i:j]][1]}
        kept = sorted(x for w, x in found.items() if w not in inside)[: shape.top]
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(kept)]
    return sorted(out)


def got(spark, rows, shape, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in phrases.report(df, shape).collect())


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"Wort{i}" for i in range(30)] + ["ÄÖ", "naïve", "\u0085x", "日本", "x\x1fy"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for i in range(n):
        words = []
        while len(words) < rng.randrange(1, 120):
            words += rng.choice([["in", "Front", "of", "the", "House"], ["new", "york"], rng.choices(vocabulary, weights)])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]) for w in words)
        out.append((rng.choice([i, 3, None]), text, rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("share", [1, 3])
def test_same_as_plain(spark, share):
    rows = made(150, share) + [(1, None, "en"), (2, "", None), (3, " .\n\t", "de")]
    shape = phrases.Shape(least=12, share=share, top=40)
    want = plain(rows, shape)
    assert got(spark, rows, shape) == want and len(want) > 30


def test_phrases_that_the_sample_has_not_seen(spark):
    # a sample of no text at all: every frequent phrase is a failure or opened up by one
    rows = made(120, 9)
    shape = phrases.Shape(least=10, share=10**9, words=4)
    assert got(spark, rows, shape) == plain(rows, shape)


def test_a_small_map_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", phrases._PAGES * 8)
    rows = made(100, 5)
    shape = phrases.Shape(least=10, share=3)
    assert got(spark, rows, shape) == plain(rows, shape)


def test_cut_texts_have_the_same_phrases(monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 64)
    rows = made(40, 7) + [(1, "a " * 500, "en"), (2, "b" * 300 + " c " * 90, "en"), (3, " " * 200 + "x y z", "en")]
    counts, totals = plain_counts(rows, 5)
    seen, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for stretch in phrases.stretches([text.encode()], 5):
            for k, whole, _ in stretch.keys(5, phrases._seeds(lang)):
                for i in stretch.counted(k, whole).tolist():
                    seen[lang, tuple(stretch.phrase(i, k).decode().split(" "))] += 1
                    words[lang] += k == 1
    assert seen == counts and words == totals


def test_sums_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    rows = made(60, 8)
    shape = phrases.Shape(least=6, share=2)
    assert got(spark, rows, shape) == plain(rows, shape)


def test_large_products_and_ties(spark):
    found = spark.createDataFrame([("en", 1, "a", 10**13), ("en", 1, "b", 2 * 10**13), ("en", 1, "c", 10**13), ("en", 2, "a b", 10**13), ("en", 2, "b c", 10**13), ("en", 3, "a b c", 10**13)], "lang string, k int, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    rows = phrases.scored(found, totals)
    got = {r.phrase: (r.l, r.r, r.score) for r in rows.collect()}
    assert got["a b"] == (10**13, 2 * 10**13, 5000) and got["a b c"] == (10**13, 10**13, 10000)
    assert [r.phrase for r in phrases.not_inside_longer(rows).collect()] == ["a b c"]


def test_empty_table(spark):
    assert got(spark, [], phrases.Shape()) == [] and got(spark, [(1, None, None)], phrases.Shape()) == []
