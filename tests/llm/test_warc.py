"""Archives: written, normalised, read by index, held against the pages themselves."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm import warc
from cloakwork.sources.tables import table


def brute(rows):
    """rows of (page_id, html)"""
    groups = defaultdict(list)
    for p, html in rows:
        groups[(html or "").encode()].append(p)
    out = []
    for p, html in rows:
        raw = (html or "").encode()
        latest = max(groups[raw], key=lambda x: -(2**63) if x is None else x)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = p != latest
        out.append((p, len(raw), digest, "revisit" if again else "response", latest if again else None))
    return sorted(out, key=repr)


def test_whole_table(spark, tiny):
    pages = table(spark, tiny, "pages")
    pages = pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html").filter("page_id % 3 = 0"))
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    assert got == brute([(r.page_id, r.html) for r in pages.collect()])
    assert {r[3] for r in got} == {"revisit", "response"}


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "http://a b\r\nWARC-Type: x", "", 2), (3, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", 3)]
    rows += [(4, "u", "é\r\n\r\n" * 3, 4), (5, "u", "é\r\n\r\n" * 3, 5), (None, "u", "é\r\n\r\n" * 3, 6), (7, "v", "big " * 400_000, 7), (9, "w", "\n", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes long")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == brute([(p, h) for p, _, h, _ in rows])
    twice = spark.createDataFrame([(1, "u", "same", 0)] * 2, pages.schema)
    assert [r.record_type for r in warc.round_trip(twice).collect()] == ["response"] * 2
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_base32(spark):
    made = [(hashlib.sha1(str(i).encode()).hexdigest(),) for i in range(200)] + [("0" * 40,)]
    frame = spark.createDataFrame(made, "h string").select("h", warc.base32_of_hex(warc.F.col("h")).alias("b"))
    for r in frame.collect():
        assert r.b == base64.b32encode(bytes.fromhex(r.h)).decode()


def record(payload):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: b.replace(b"a", b"\r\n\r\n"))), st.integers(1, 50), st.booleans())
def test_normalising_any_payloads(tmp_path_factory, payloads, piece, members):
    folder = tmp_path_factory.mktemp("w")
    made = [record(p) for p in payloads]
    whole = b"".join(gzip.compress(r) for r in made) if members else gzip.compress(b"".join(made))
    (folder / "a.gz").write_bytes(whole)
    was, warc._READ = warc._READ, piece
    try:
        assert warc.normalise_file(f"{folder}/a.gz", f"{folder}/b.warc.gz") == len(made)
    finally:
        warc._READ = was
    data = (folder / "b.warc.gz").read_bytes()
    lines = [warc.json.loads(x) for x in (folder / "b.warc.gz.idx").read_bytes().splitlines()]
    assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in lines] == made
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(made)


@pytest.mark.parametrize("cut", [1, 9, 30])
def test_a_cut_archive_is_an_error(tmp_path, cut):
    (tmp_path / "a.gz").write_bytes(gzip.compress(record(b"some payload"))[:-cut])
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise_file(f"{tmp_path}/a.gz", f"{tmp_path}/b.gz")
    assert not (tmp_path / "b.gz").exists()
