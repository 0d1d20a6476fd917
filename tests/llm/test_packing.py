"""Packing: every id once, limits held, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakwork.llm import packing
from cloakwork.llm.registry import BYTES_50K, WORDS_49K
from cloakwork.llm.tokens import Vocabulary
from cloakwork.sources.tables import table


def padding(lengths, capacity=packing.CAPACITY):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def whole(rows):
    """Sequences as lists of pieces, checked to be gapless."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    return {s: sum(p.length for p in pieces) for s, pieces in sequences.items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name, tiny):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{tiny}/documents.parquet")["text"].to_pylist()]
    texts += ["", " ", "\n\n", "a  b\n c\t\td ", "it's I'LL we’ve don't", "x  y  z  ", "\x0b\x0ca\x1cb\x85c", "<|endoftext|> a<|startoftext|>b"]
    texts += ["ΟΔΟΣ ΣΑΣ", "é ́a", "日本 語 123 4.5", "w" * 300, "😀 🇩🇪🇫🇷 ‍"]
    vocabulary = {"word_bpe_49k.json": WORDS_49K, "byte_bpe_50k.json": BYTES_50K}[name]
    encoder = vocabulary.encoder()
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, encoder.kind).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r  abAΣé'sl,.1́"), max_size=30), max_size=4))
def test_encoder_on_odd_texts(texts):
    for name, vocabulary in (("word_bpe_49k.json", WORDS_49K), ("byte_bpe_50k.json", BYTES_50K)):
        whole_texts = Vocabulary(public_tokenizers.path(name), None, 0).encoder()
        assert vocabulary.encoder().encode(texts) == whole_texts.encode(texts)


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    rows = packing.pack_documents(docs, WORDS_49K, with_ids=True).collect()
    seen = defaultdict(dict)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == ids and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen[r.doc_id][r.start] = r.length
    for d, ids in want.items():
        at = 0
        for start in sorted(seen[d]):
            assert start == at
            at += seen[d][start]
        assert at == len(ids)
    lengths = whole(rows)
    assert max(lengths.values()) <= 2048
    assert padding(lengths.values()) < 0.01 * sum(lengths.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=0, max_size=80), st.integers(2, 9), st.booleans())
def test_limits(sizes, segments, cut):
    tokens = np.array(sizes, np.int64)
    loss = tokens // 2
    out = packing.pack(tokens, loss, 64, segments, 40, cut)
    parts, sequences = defaultdict(list), defaultdict(list)
    for example, start, n, sequence, offset in out:
        parts[example].append((start, n))
        sequences[sequence].append((offset, n, example))
    assert sorted(parts) == list(range(len(sizes)))
    for example, pieces in parts.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == sizes[example] and (cut or len(pieces) == 1)
    for held in sequences.values():
        at = 0
        for offset, n, _ in sorted(held):
            assert offset == at
            at += n
        assert at <= 64 and len(held) <= segments
        if not cut:
            assert sum(loss[e] for _, _, e in held) <= 40


def test_instruction_examples(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(1, 900), rnd.randint(0, 300)) for i in range(1500)] + [(None, None, None), (7, 5000, 9), (8, 20, 3000)]
    rows += [(3, 10, 5)] * 3
    examples = spark.createDataFrame(rows, "id long, n long, loss long")
    out = packing.pack_examples(examples, "id", "n", "loss", capacity=1024, segments=8, max_loss=300).collect()
    assert sorted(((r.example_id or 0), r.length, r.loss_tokens) for r in out) == sorted((a or 0, b or 0, c or 0) for a, b, c in rows)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
    full = whole(out)
    for s, held in sequences.items():
        alone = len(held) == 1
        assert alone or (full[s] <= 1024 and len(held) <= 8 and sum(r.loss_tokens for r in held) <= 300)
    # at least as good as a lower bound by any one limit allows, within a tenth
    bound = max(sum(r.length for r in out) / 1024, len(out) / 8, sum(r.loss_tokens for r in out) / 300)
    assert len(sequences) < 1.1 * bound + 2


def test_conversations_under_three_limits(spark, tiny):
    turns = table(spark, tiny, "conversations")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(lambda: [0, 0])
    for r in turns.collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n if r.role == "assistant" else 0
    out = packing.pack_conversations(turns, WORDS_49K, capacity=2000, segments=3, max_loss=1400).collect()
    assert len(out) == len(want) and {r.conv_id: [r.length, r.loss_tokens] for r in out} == want

    def sequences(rows):
        held = defaultdict(list)
        for r in rows:
            held[r.sequence_id].append(r)
        return [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in held.values()]

    whole(out)
    assert all(k == 1 or (n <= 2000 and k <= 3 and loss <= 1400) for n, k, loss in sequences(out))
    # the limits on segments and loss do something here
    loose = sequences(packing.pack_conversations(turns, WORDS_49K, capacity=2000, segments=100, max_loss=2000).collect())
    assert max(k for _, k, _ in loose) > 3 and max(loss for _, _, loss in loose) > 1400
    bound = max(sum(r.length for r in out) / 2000, len(out) / 3, sum(r.loss_tokens for r in out) / 1400)
    assert len(sequences(out)) < 1.25 * bound + 2


def test_odd_turns(spark):
    rows = [(1, None, None, 5), (1, "assistant", None, 6), (None, "assistant", "a b", 7), (None, "user", "", 8), (2, "assistant", "w " * 50_000, 9)]
    turns = spark.createDataFrame(rows, "conv_id long, role string, text string, n long").withColumnRenamed("n", "loss")
    out = {r.conv_id: (r.length, r.loss_tokens, r.offset) for r in packing.pack_conversations(turns, WORDS_49K).collect()}
    assert out[1][:2] == (2, 1) and out[None][0] == out[None][1] + 1 and out[2][0] > packing.DIALOGUE and out[2][2] == 0
    assert packing.pack_conversations(turns.limit(0), WORDS_49K).collect() == []


def test_equal_rows_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    docs = spark.createDataFrame([(None, "")] * 1500 + [(7, "some words")] * 500, "doc_id long, text string")
    out = packing.pack_documents(docs, WORDS_49K).collect()
    blocks = defaultdict(int)
    for r in out:
        blocks[r.sequence_id >> 32] += r.length
    tokens = next(r.doc_tokens for r in out if r.doc_id == 7)
    assert sum(blocks.values()) == 1500 + 500 * tokens and len(blocks) == 40 and max(blocks.values()) < 3 * 50 * tokens
    examples = spark.createDataFrame([(None, 3, 1)] * 2000, "id long, n long, loss long")
    dealt = defaultdict(int)
    for r in packing.pack_examples(examples, "id", "n", "loss").collect():
        dealt[r.sequence_id >> 32] += 1
    assert sum(dealt.values()) == 2000 and len(dealt) == 40 and max(dealt.values()) < 150


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "some words", 7), (3, "again", 8), (3, "again", 9), (4, "w" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long")
    out = packing.pack_documents(docs, WORDS_49K).collect()
    assert {r.doc_tokens for r in out if r.doc_id in (1, 2)} == {1}
    assert sum(r.length for r in out if r.doc_id == 3) == 2 * next(r.doc_tokens for r in out if r.doc_id == 3)
    assert padding(whole(out).values()) == 0
    assert packing.pack_documents(docs.limit(0), WORDS_49K).collect() == []


def test_sequences_closed_by_segments_are_powers_of_two():
    tokens = np.array([3] * 1000 + [5] * 300)
    out = packing.pack(tokens, None, 2048, 256, None, cut=True)
    filled, taken = defaultdict(int), defaultdict(int)
    for e, _, n, s, o in out:
        assert n > 0 and o == filled[s]
        filled[s] += n
        taken[e] += n
    assert len(filled) > 5 and all(n & (n - 1) == 0 for n in filled.values())
    assert [taken[e] for e in range(len(tokens))] == tokens.tolist()
