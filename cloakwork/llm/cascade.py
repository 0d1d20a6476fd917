"""Quality rules as a short-circuit cascade.

Every document gets the base figures; a document that fails the base is rejected. The others go through the rules
below one after another and stop at the first that rejects. Cost and selectivity of each rule are estimated on a
sample first, and the rules run by rejection per cost, highest first. The verdict does not depend on the order, only
the work does.

Null texts and texts without a word have no words, so they fail the base. Null ids stay null; repeated rows are judged
each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cloakwork.llm.texts import mixed, raw_texts, small_batches

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Documents on which cost and selectivity are estimated; it decides nothing but the order of the rules.
SAMPLE = 2000
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Text:
    """Figures of one text, each computed when it is first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        raw = self.raw
        return len(raw.decode()) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = len(self.words)
        if n <= WINDOW:
            return 0
        word = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)
        window = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + word[i : n - WINDOW + 1 + i]
        window = mixed(window)
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        if not same.any():
            return 0
        edge = np.zeros(n + 1, np.int64)
        repeated = np.zeros(len(window), bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        at = np.flatnonzero(repeated)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        return int(np.count_nonzero(np.cumsum(edge)))

    @cached_property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * n


#: Each says whether a text is rejected. Only texts that pass the base, so of 20 words at least, get here.
RULES: dict[str, Callable[[Text], bool]] = {
    # more than one symbol in ten words
    "symbols": lambda t: 10 * t.n_symbols > len(t.words),
    # words too short or too long on average
    "word_length": lambda t: not 2 * len(t.words) <= t.word_chars <= 15 * len(t.words),
    # more than half of the lines were there before
    "dup_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    # one word makes up more than a third
    "top_word": lambda t: 3 * Counter(t.words).most_common(1)[0][1] > len(t.words),
    # more than a third of the words repeat the word before them
    "stutter": lambda t: 3 * sum(map(eq, t.words, t.words[1:])) > len(t.words),
    # more than half of the words end in an exclamation mark
    "shouting": lambda t: 2 * sum(w.endswith(b"!") for w in t.words) > len(t.words),
}


def rule_order(docs: DataFrame, text: str = "text", rules: dict[str, Callable] = RULES, sample: int = SAMPLE) -> list[str]:
    """The rules by rejection per cost, as measured on about ``sample`` documents that pass the base."""
    small_batches(docs)
    n = docs.count()
    some = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    some = some.sample(min(1.0, sample / n), seed=1) if n else some

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hits, tried = Counter(), Counter(), 0
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                if Text(raw).base_failed:
                    continue
                tried += 1
                for name, rejects in rules.items():
                    alone = Text(raw)
                    _ = alone.words, alone.n_symbols, alone.n_dup_lines, alone.word_chars  # known from the base
                    began = time.perf_counter_ns()
                    hits[name] += rejects(alone)
                    took[name] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_pydict(
            {"rule": list(rules), "ns": [took[r] for r in rules], "hits": [hits[r] for r in rules], "tried": [tried] * len(rules)},
            pa.schema([("rule", pa.string()), ("ns", pa.int64()), ("hits", pa.int64()), ("tried", pa.int64())]),
        )

    figures = some.mapInArrow(measure, "rule string, ns long, hits long, tried long").groupBy("rule").agg(
        F.sum("ns").alias("ns"), F.sum("hits").alias("hits")
    )
    rate = {r.rule: (r.hits + 0.5) / (r.ns + 1) for r in figures.collect()}
    return sorted(rules, key=lambda name: (-rate.get(name, 0.0), name))


def verdict(order: list[str], rules: dict[str, Callable] = RULES) -> Callable[[Column], Column]:
    """A function of a text column: a struct of the base figures and ``kept``."""

    @pandas_udf(FIGURES)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            t = Text((text or "").encode())
            kept = not t.base_failed and not any(rules[name](t) for name in order)
            rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, kept))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FIGURES.split(", ")])

    return judge


def figures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base figures and ``kept`` of every document."""
    judge = verdict(rule_order(docs, text))
    judged = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), judge(F.col(f"`{text}`")).alias("q"))
    return judged.select("doc_id", "q.*")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    return docs.filter(verdict(rule_order(docs, text))(F.col(f"`{text}`")).getField("kept"))
