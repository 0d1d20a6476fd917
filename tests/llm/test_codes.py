"""Vector codes against a plain computation with Python's integers, and odd rows."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from cloakwork.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, shape):
    kept = [(i, [math.floor(shape.scale * x) if abs(x) < 2**52 else int(x) * shape.scale for x in v], y) for i, v, y, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // shape.parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[: shape.entries]] for p in range(shape.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(shape.rounds):
        for p in range(shape.parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, sums = [], {}
    for i, v, y in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(shape.parts)]
        error = sum(f[0] for f in found)
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, y))
        sums[y] = sums.get(y, 0) + error
    return sorted(((i, c, e, sums[y], digest) for i, c, e, y in out), key=repr)


def got(spark, rows, shape, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = codes.report(df, shape).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_same_as_plain_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 16)
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(rng.randrange(60), vec(), rng.choice([1, 2, None]), "x") for _ in range(120)]
    same = vec()
    rows += [(7, same, 1, "x")] * 5 + [(None, vec(), 1, "x"), (None, vec(), None, "x")]  # repeated rows, null ids
    rows += [(1, None, 1, "x"), (2, [None] * 8, 1, "x"), (0, [float("nan")] * 8, 1, "x"), (0, [float("-inf")] + same[1:], 2, "x")]
    shape = codes.Shape(entries=12, rounds=3)
    assert got(spark, rows, shape) == plain(rows, shape)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 2)] * 4, 0, "") for i in range(9)]
    shape = codes.Shape(entries=4, rounds=2)
    want = plain(rows, shape)
    assert got(spark, rows, shape) == want and {r[1] for r in want} == {"00000000", "01010101"}


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 6]) for _ in range(4)], i % 3, "") for i in range(40)]
    shape = codes.Shape(entries=5)
    assert got(spark, rows, shape) == plain(rows, shape)
    # beyond 64 bits only the reported error is cut off
    far = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(70, 80) for _ in range(4)], 0, "") for i in range(6)]
    shape = codes.Shape(entries=2)
    most = 2**63 - 1
    want = sorted(((i, c, min(e, most), min(s, most), d) for i, c, e, s, d in plain(far, shape)), key=repr)
    assert got(spark, far, shape) == want


def test_other_widths_and_empty_tables(spark):
    rows = [(i, [0.5, float(i), 0.25, 1.0], 0, "") for i in range(6)]
    odd = [(100, [1.0], 0, ""), (101, [], 0, ""), (-5, [1.0] * 8, 5, "")]
    shape = codes.Shape(entries=3)
    out = got(spark, rows + odd, shape)
    assert [r for r in out if r[0] not in (100, 101, -5)] == plain(rows, shape)
    assert {r[:3] for r in out if r[0] in (100, 101, -5)} == {(100, None, None), (101, None, None), (-5, None, None)}
    assert got(spark, [], shape) == [] and got(spark, [(1, None, 2, "")], shape) == []


def test_one_label_and_vector_for_most_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [0.0, float(i), 1.0, 1.0], None if i % 3 else i, "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = codes.report(df, codes.Shape(entries=16))
    assert out.count() == 3000 and out.filter("label is null").agg(F.countDistinct("label_error")).first()[0] == 1
