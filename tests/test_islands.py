"""Span tables are gathered once, and chosen from as a plain walk does."""

import random

import pytest

from cloakwork.functions.overlap import SLICE
from cloakwork.operators import spans

COLUMNS = "doc_id long, start int, end int, seq int, score double, value string"


def _plain(rows, mode):
    """Kept spans of one text, with island and place, by the definition."""
    rows, out, number = sorted(rows, key=lambda r: r[:4]), [], 0
    while rows:
        reach, n = rows[0][1], 1
        while n < len(rows) and rows[n][0] < reach:
            reach, n = max(reach, rows[n][1]), n + 1
        isle, rows, number, kept, skip = rows[:n], rows[n:], number + 1, [], -1
        for x in sorted(isle, key=lambda r: (r[0], -r[1], r[2])) if mode == "longest" else isle:
            if x[0] < skip:
                continue
            near = [e for e in isle if e is x or e[0] < x[1] and e[1] > x[0] and e not in kept]
            if mode == "longest":
                best = x
            else:
                near = [e for e in near if e[1] > x[0]]
                best = max(near, key=lambda e: e[3]) if len({e[3] for e in isle}) > 1 else near[0]
            skip = best[1]
            kept.append(best)
        out += [(*k, number, i) for i, k in enumerate(kept)]
    return out


def _rows(seed, scores):
    rng, out = random.Random(seed), []
    for doc in range(40):
        for seq in range(rng.choice([1, 2, 9, 40])):
            start = rng.choice([rng.randrange(300), 65_530 + rng.randrange(12), 131_060 + rng.randrange(20)])
            out.append((doc, start, start + rng.randint(1, rng.choice([3, 30, 70_000 if seq == 0 else 5])), seq, rng.choice(scores), f"v{seq}"))
    return out


@pytest.mark.parametrize("mode", ["compat", "longest"])
@pytest.mark.parametrize("scores", [[0.95], [0.3, 0.95, 0.99]])
def test_kept_spans_are_those_of_a_plain_walk(spark, mode, scores):
    rows = _rows(3, scores)
    got = spans.resolve_overlaps(spark.createDataFrame(rows, COLUMNS).repartition(5), mode=mode)
    assert got.columns == ["doc_id", "start", "end", "seq", "island", "emit_pos", "score", "value"]
    want = [(d, *k) for d in range(40) for k in _plain([r[1:5] for r in rows if r[0] == d], mode)]
    assert sorted((r.doc_id, r.start, r.end, r.seq, r.score, r.island, r.emit_pos) for r in got.collect()) == sorted(want)
    assert all(r.value == f"v{r.seq}" for r in got.collect())


@pytest.mark.parametrize("chunk", [4, 256, 65_536])
def test_islands_are_numbered_along_the_text(spark, chunk):
    rows = [(*r[:4],) for r in _rows(4, [0.95])] + [(None, 1, 2, 0), (7, None, 3, 99)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, seq int").repartition(5)
    want, last = [], (None, 0, 0)
    for doc, start, end, seq in sorted(r for r in rows if None not in r):
        number, reach = (last[1], last[2]) if doc == last[0] else (0, -1)
        last = (doc, number + (start >= reach), max(reach, end) if start < reach else end)
        want.append((doc, start, end, seq, last[1]))
    out = spans.islands(df, chunk=chunk)
    assert out.columns == ["doc_id", "start", "end", "seq", "island"]
    assert sorted(tuple(r) for r in out.collect()) == want


def test_a_text_with_more_spans_than_a_slice(spark):
    df = spark.range(SLICE + 9).selectExpr("1L AS doc_id", "cast(2 * (id % 65536) as int) AS start", "cast(2 * (id % 65536) + 1 as int) AS end", "cast(id div 65536 as int) AS seq", "0.95D AS score")
    kept = spans.resolve_overlaps(df)
    assert kept.selectExpr("count(*)", "max(island)", "max(seq)").first() == (65_536, 65_536, 0)


@pytest.mark.parametrize("step", ["islands", "resolve_overlaps", "number_tokens", "order_spans"])
def test_span_tables_are_read_once(spark, step):
    rows = [(*r, "EMAIL_ADDRESS", 1, 0) for r in _rows(5, [0.95])]
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    schema = COLUMNS + ", entity_type string" + (", island long, emit_pos int" if step in ("number_tokens", "order_spans") else ", a int, b int")
    df = spark.createDataFrame(rows, schema).repartition(3)
    getattr(spans, step)(df.mapInArrow(counted, df.schema)).write.format("noop").mode("overwrite").save()
    assert ran.value == len(rows)
