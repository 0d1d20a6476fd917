"""Likelihood of texts under a subword lattice.

A text is its words, lower-cased in A to Z, and one end. A word's probability is the sum over all ways to put it together:

* as a whole, if training texts have it: its count less a discount, over all training tokens;
* from the pieces of an existing vocabulary, all segmentations: a first piece, further pieces, a stop. A character can
  always be spelled byte by byte. This way gets the mass that the discounts left over.

The lattice is summed by a forward recursion in log space, and no piece reaches over a word's end, so a text's marginal
probability is the product of its words'. The pieces' scores start from the vocabulary's own and are fitted to the
distinct training words by expectation maximisation: a backward recursion gives each piece's expected count.

Nothing grows with the corpus in one place: texts lie in blocks of bounded size, every block asks for its own distinct
words, each distinct word is scored once, and the answers go back to the blocks that asked. Only piece counts, no more
than the vocabulary has, and a few sums reach the driver.

Null texts are empty: their score is the end's. A null id counts as an empty one where ids decide on held-out rows.
Repeated rows are counted and scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.texts import id_and_text, public_id, raw_texts
from cloakwork.plans.stored import discard, stored

#: Bytes of text in a block.
BLOCK = 12_000_000
#: Rounds of fitting, and what is added to each piece's expected count.
ROUNDS, SMOOTH = 2, 0.01
MARK = "▁"
#: Longer words are summed one at a time.
TOGETHER = 48
#: Words and arcs that are handled at a time.
WORDS, ARCS = 100_000, 1_500_000
NEVER = -1e30
_LOG10 = math.log(10)
_BASE = 0x9E3779B97F4A7C15


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _BASE + ord(c) + 1) % 2**64
    return h


class Side:
    """Pieces that may stand at one kind of place, found by hash, with their log probabilities."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.pieces = hashes[order], [pieces[i] for i in order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.log = np.zeros(len(pieces))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or -1."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1)


class Pieces:
    """First pieces (without the mark), further pieces, single bytes, and the stop."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # existing scores; where they are ranks, as in vocabularies of merges, a rank stands for a frequency
        own = {model.id_to_piece(i): model.get_score(i) for i in kept}
        ranks = min(own.values()) < -100
        weight = {p: 1.0 / (10.0 - x) if ranks else math.exp(x) for p, x in own.items()}
        self.first = Side([p[1:] for p in own if p.startswith(MARK)])
        self.further = Side([p for p in own if MARK not in p])
        self.reach = max(map(len, self.further.pieces), default=1)
        self.fit(
            np.array([weight[MARK + p] for p in self.first.pieces]),
            np.array([weight[p] for p in self.further.pieces]),
            np.full(256, 1e-6),
            0.3 * sum(weight[p] for p in self.further.pieces),
        )

    def fit(self, first: np.ndarray, further: np.ndarray, byte: np.ndarray, stop: float) -> None:
        """Log probabilities from counts."""
        self.first.log = np.log(first) - math.log(first.sum())
        total = math.log(further.sum() + byte.sum() + stop)
        self.further.log, self.byte, self.stop = np.log(further) - total, np.log(byte) - total, math.log(stop) - total


def _scalar(word: str, pieces: Pieces, counts: list | None = None) -> float:
    """Log of the sum over all segmentations of one word; expected counts are added to ``counts``."""
    first, further, reach, n = pieces.first, pieces.further, pieces.reach, len(word)
    spelled = [sum([float(pieces.byte[b]) for b in c.encode()]) for c in word]
    arcs: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    at = []
    for end in range(n + 1):
        k = first.number.get(word[:end]) if end <= reach else None
        logs = [float(first.log[k])] if k is not None else []
        if end:
            logs.append(at[end - 1] + spelled[end - 1])
        for start in range(max(0, end - reach), end):
            k = further.number.get(word[start:end])
            if k is not None:
                arcs[end].append((start, k))
                logs.append(at[start] + float(further.log[k]))
        at.append(_sum(logs) if logs else NEVER)
    total = at[n] + pieces.stop
    if counts is not None:
        back = [NEVER] * n + [pieces.stop]
        for end in range(n, 0, -1):
            for start, k in arcs[end]:
                counts[1][k] += math.exp(at[start] + further.log[k] + back[end] - total)
                back[start] = _sum([back[start], float(further.log[k]) + back[end]])
            share = math.exp(at[end - 1] + spelled[end - 1] + back[end] - total)
            for b in word[end - 1].encode():
                counts[2][b] += share
            back[end - 1] = _sum([back[end - 1], spelled[end - 1] + back[end]])
        for end in range(min(n, reach) + 1):
            k = first.number.get(word[:end])
            if k is not None:
                counts[0][k] += math.exp(first.log[k] + back[end] - total)
    return total


def _sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum([math.exp(x - top) for x in logs])) if len(logs) > 1 else top


def _together(codes: np.ndarray, pieces: Pieces, counts: list | None = None) -> np.ndarray:
    """``_scalar`` for words of one length, given as rows of code points."""
    first, further, (rows, n), base = pieces.first, pieces.further, codes.shape, np.uint64(_BASE)
    letters, of = np.unique(codes, return_inverse=True)
    of = of.reshape(codes.shape)
    spelled = np.array([pieces.byte[list(chr(c).encode())].sum() for c in letters.tolist()])[of] if n else codes.astype(float)
    h, starts, at = np.zeros(rows, np.uint64), [], []
    for end in range(n + 1):
        k = first.find(h) if end <= pieces.reach else np.full(rows, -1)
        starts.append(k)
        at.append(np.where(k >= 0, first.log[k], NEVER))
        if end < n:
            h = h * base + codes[:, end] + np.uint64(1)
    arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for start in range(n):
        h = np.zeros(rows, np.uint64)
        at[start + 1] = np.logaddexp(at[start + 1], at[start] + spelled[:, start])
        for end in range(start + 1, min(n, start + pieces.reach) + 1):
            h = h * base + codes[:, end - 1] + np.uint64(1)
            k = further.find(h)
            if (k >= 0).any():
                arcs[start, end] = k, np.where(k >= 0, further.log[k], NEVER)
                at[end] = np.logaddexp(at[end], at[start] + arcs[start, end][1])
    total = at[n] + pieces.stop
    if counts is None:
        return total
    back = [np.full(rows, pieces.stop)] * (n + 1)
    for start in range(n - 1, -1, -1):
        back[start] = back[start + 1] + spelled[:, start]
        share = np.exp(at[start] + back[start] - total)
        for c, x in zip(letters.tolist(), np.bincount(of[:, start], share, minlength=len(letters)).tolist()):
            for b in chr(c).encode():
                counts[2][b] += x
        for end in range(start + 1, min(n, start + pieces.reach) + 1):
            if (start, end) in arcs:
                k, log = arcs[start, end]
                hit = k >= 0
                share = np.exp(at[start][hit] + log[hit] + back[end][hit] - total[hit])
                counts[1] += np.bincount(k[hit], share, minlength=len(further.log))
                back[start] = np.logaddexp(back[start], log + back[end])
    for end, k in enumerate(starts):
        hit = k >= 0
        counts[0] += np.bincount(k[hit], np.exp(first.log[k[hit]] + back[end][hit] - total[hit]), minlength=len(first.log))
    return total


def marginals(words: list[str], pieces: Pieces, counts: list | None = None) -> np.ndarray:
    """Log of the sum over all segmentations of each word."""
    out = np.zeros(len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        if n > TOGETHER:
            out[rows] = [_scalar(words[i], pieces, counts) for i in rows]
            continue
        # as many at a time as bound the memory for their arcs
        step = max(256, ARCS // (n * min(n, pieces.reach) + 1))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), "<u4").reshape(len(some), n)
            out[some] = _together(codes.astype(np.uint64), pieces, counts)
    return out


def _words_of_blocks(texts: DataFrame) -> DataFrame:
    """``block, word, n``: each block's distinct words and how often its training texts have them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = zip(blocks, held, raw_texts(batch.column(2)))
            for block, own in groupby(rows, key=lambda r: r[0]):  # sorted; a block may be seen in several batches
                counts, others = Counter(), set()
                for _, out, raw in own:
                    words = raw.lower().split()
                    others.update(words) if out else counts.update(words)
                words = [*counts, *(w for w in others if w not in counts)]
                n = np.zeros(len(words), np.int64)
                n[: len(counts)] = list(counts.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), block)), pa.array(words, pa.binary()), pa.array(n)], ["block", "word", "n"]
                )

    ordered = texts.select("block", "held_out", "text").repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(each, "block long, word binary, n long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of many words: the sums are made for all words of one length together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= WORDS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _fitted(words: DataFrame, pieces: Pieces, n_words: int, rounds: int) -> Pieces:
    """The pieces with scores fitted to the distinct words."""
    context = words.sparkSession.sparkContext
    for _ in range(rounds if n_words else 0):
        # no more pieces than the vocabulary has
        given = context.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            own = given.value
            counts = [np.zeros(len(own.first.log)), np.zeros(len(own.further.log)), np.zeros(256)]
            for batch in _gathered(batches):
                marginals([w.decode() for w in batch.column(0).to_pylist()], own, counts)
            for kind, n in enumerate(counts):
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind)), pa.array(used), pa.array(n[used])], ["kind", "piece", "n"])

        rows = words.select("word").mapInArrow(expect, "kind long, piece long, n double")
        counts = [np.full(len(pieces.first.log), SMOOTH), np.full(len(pieces.further.log), SMOOTH), np.full(256, SMOOTH)]
        for r in rows.groupBy("kind", "piece").agg(F.sum("n").alias("n")).collect():
            counts[r["kind"]][r["piece"]] += r["n"]
        pieces.fit(*counts, n_words + SMOOTH)
    return pieces


def scores(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", fold: int = 1, folds: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``path`` is a sentencepiece model. Documents whose id's text has a CRC-32 of ``fold`` modulo ``folds`` are held out;
    the model learns from the others. ``base_score`` is that of word counts with one half added; both are log10.
    """
    texts = id_and_text(docs, doc_id, text)
    fold_of = F.crc32(F.coalesce(public_id().cast("string"), F.lit("")).cast("binary")) % folds
    texts = texts.withColumn("held_out", fold_of == fold)
    sums = texts.agg(
        F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")
    ).first()
    blocks = max(1, -(-sums["bytes"] // BLOCK))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("d", "t"), F.lit(blocks)))

    asked = stored(_words_of_blocks(texts))
    words = stored(asked.groupBy("word").agg(F.sum("n").alias("c")))
    known = words.filter("c > 0")
    found = known.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count(F.lit(1)).alias("words"),
        F.count(F.when(F.col("c") == 1, 1)).alias("once"),
        F.count(F.when(F.col("c") == 2, 1)).alias("twice"),
    ).first()
    ends = sums["ends"]
    total, distinct = found["tokens"] + ends, found["words"] + (ends > 0)
    base = math.log10(total + 0.5 * (distinct + 1))
    # what a count is too high by on average, from words seen once and twice
    discount = min(0.9, max(0.1, found["once"] / max(1, found["once"] + 2 * found["twice"])))
    pieces = _fitted(known, Pieces(path), found["words"], rounds)
    spread = docs.sparkSession.sparkContext.broadcast(pieces)
    left = math.log((discount * distinct + 1) / (total + 1))
    whole_of = math.log(total + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for batch in _gathered(batches):
            c = batch.column(1).to_numpy()
            log = left + marginals([w.decode() for w in batch.column(0).to_pylist()], own)
            known = c > 0
            log[known] = np.logaddexp(log[known], np.log(c[known] - discount) - whole_of)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log / _LOG10)], ["word", "c", "log"])

    scored = stored(words.select("word", "c").mapInArrow(score, "word binary, c long, log double"))
    discard(words)
    # an end is one more word, spelled with no letters at all
    end_log = left + float(pieces.first.log[pieces.first.number[""]]) + pieces.stop
    end_score = (_sum([end_log, math.log(ends - discount) - whole_of]) if ends else end_log) / _LOG10
    end_base = math.log10(ends + 0.5) - base
    answers = stored(asked.select("block", "word").distinct().join(scored, "word"))
    discard(asked, scored)

    def judge(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        number = dict(zip(answers.word, range(len(answers))))
        c = answers.c.to_numpy(np.int64)
        log, base_log = answers.log.to_numpy(np.float64), np.log10(c + 0.5) - base
        rows = []
        for d, out, raw in zip(own.d, own.held_out, own.text):
            at = np.fromiter(map(number.__getitem__, raw.encode().lower().split()), np.int64)
            n_known = int(np.count_nonzero(c[at])) + (ends > 0)
            rows.append((d, out, len(at) + 1, n_known, total, base_log[at].sum() + end_base, log[at].sum() + end_score))
        return pd.DataFrame(rows, columns=["d", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = "d long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked_by = texts.select("block", "d", "held_out", "text").groupBy("block")
    out = asked_by.cogroup(answers.groupBy("block")).applyInPandas(judge, kinds)
    return out.select(public_id().alias("doc_id"), *[c.split()[0] for c in kinds.split(", ")[1:]])
