"""The pipeline's stages against brute force, and every query registered."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline as pipeline
from cloakwork.llm import cascade, mixing, suffixes
from cloakwork.llm.registry import ORACLES, QUERIES
from cloakwork.sources.tables import table
from tests.llm.test_mixing import check
from tests.llm.test_simhash import brute_fingerprint, brute_roots
from tests.llm.test_suffixes import brute


def by_id(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns = docs.columns
    given = by_id(docs)

    kept = pipeline.quality(spark, docs, tiny)
    assert kept.columns == columns
    rejects = lambda t: t.base_failed or any(rule(t) for rule in cascade.RULES.values())
    want = {d: t for d, t in given.items() if not rejects(cascade.Text((t or "").encode()))}
    assert by_id(kept) == want and len(want) < len(given)

    one = pipeline.near_duplicates(spark, kept, tiny)
    assert one.columns == columns
    ids = sorted(want)
    roots = brute_roots([brute_fingerprint(want[d]) for d in ids], ids)
    want = {d: want[d] for d, r in zip(ids, roots) if d == r}
    assert by_id(one) == want and len(want) < len(ids)

    cut = pipeline.repeated_passages(spark, one, tiny)
    assert cut.columns == columns
    left = {}
    for d, raw, gone in brute(sorted((d, (t or "").encode()) for d, t in want.items()), suffixes.DEPTH):
        starts = [i for i in range(len(raw)) if gone[i] and not (i and gone[i - 1])]
        ends = [i + 1 for i in range(len(raw)) if gone[i] and not (i + 1 < len(raw) and gone[i + 1])]
        for a, b in zip(starts, ends):  # whole characters only
            for i in range(a, b):
                if raw[i] & 0xC0 == 0x80 and all(raw[j] & 0xC0 == 0x80 for j in range(a, i + 1)):
                    gone[i] = 0
            last = next(i for i in range(b - 1, a - 1, -1) if raw[i] & 0xC0 != 0x80)
            if last + len(raw[last : last + 4].decode(errors="ignore")[:1].encode()) > b:
                gone[last:b] = bytes(b - last)
        left[d] = bytes(c for c, g in zip(raw, gone) if not g).decode()
    assert by_id(cut) == left
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    check(mixing.choose(cut).collect(), Counter((d, len(t.encode().split())) for d, t in left.items()))
    mixed = pipeline.mixture(spark, cut, tiny)
    assert mixed.columns == columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
    assert taken == +Counter({r.doc_id: r.taken for r in mixing.choose(cut).collect()})

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(plain.encode(r.text, add_special_tokens=False).ids) + 1
    packed, seen = pipeline.packed(spark, mixed, tiny).collect(), Counter()
    for r in packed:
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert seen == tokens


def test_registered():
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    queries = entry_module.queries()
    assert "pipeline" in queries and {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) <= set(queries) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_empty(spark, tiny):
    docs = table(spark, tiny, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.collect() == []
        if "text" in docs.columns:
            docs = spark.createDataFrame([], docs.schema)
