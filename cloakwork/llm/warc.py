"""WARC archives: pages to records, a normaliser for archives compressed as one stream, reading by offset index.

An archive compressed as a whole (one gzip stream over all records) can only be read from its start. The normaliser
inflates such a stream once, writes every record as a gzip member of its own, and next to the archive a sidecar index: a
line for each record with its offset, its length, its type and its id. With it any record can be read by itself.

Of the pages with equal payloads the one with the largest id is stored as a response; the others are revisits that name
it and repeat only its headers. Payloads shorter than ``least_bytes`` are always stored.

A null page is an empty payload. A null id is the smallest, and repeated rows of the largest id are all responses. A
null address leaves its header out; blanks and control characters in addresses are written as ``%20``. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.files import each_file, opened, written
from cloakwork.llm.texts import NULL_ID, small_batches
from cloakwork.plans.stored import stored, work_folder

END = "\r\n\r\n"
URN = "urn:page:"
_READ = 1 << 20


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a hexadecimal digest whose length is a multiple of five digits, as of SHA-1: five digits give four."""
    parts = [
        F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``record``: the text of a WARC record for each page, without the empty lines after it."""
    small_batches(pages)
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(f"`{page_id}`").cast("long"), F.lit(NULL_ID)).alias("p"),
        F.regexp_replace(F.col(f"`{url}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("address"),
        body.alias("payload"),
        F.sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    # payloads are equal if their SHA-1 and length are; only those that occur again are looked up. They are stored first, so
    # that Spark knows how few they are before it would shuffle whole pages
    equal = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes")
    latest = equal.agg(F.max("p").alias("latest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(stored(latest.drop("n")), ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("p") < F.col("latest"), F.lit(False))

    def urn(c: str) -> Column:
        return F.concat(F.lit(f"<{URN}"), F.when(F.col(c) != NULL_ID, F.col(c).cast("string")).otherwise(F.lit("")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn("p")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("address")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("latest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    ]
    rows = rows.withColumn("block", block)
    return rows.select(F.concat(F.concat_ws("\r\n", *head), F.lit(END), F.col("block")).alias("record"))


def write_monolithic(rows: DataFrame, folder: str) -> None:
    """Archives of one gzip stream each, as Spark's text writer makes them: a record, two line ends, the next one."""
    rows.write.option("compression", "gzip").option("lineSep", END).text(folder)


def _inflated(file: pa.NativeFile) -> Iterator[bytes]:
    """A gzip file's content, piece by piece; further members follow on."""
    inflate, data = zlib.decompressobj(31), file.read(_READ)
    while data:
        out = inflate.decompress(data, _READ)
        if out:
            yield out
        data = inflate.unconsumed_tail
        if inflate.eof:
            data = inflate.unused_data or file.read(_READ)
            inflate = zlib.decompressobj(31)
        elif not data:
            data = file.read(_READ)
            if not data:
                rest = inflate.flush()
                if rest:
                    yield rest
                if not inflate.eof:
                    raise ValueError("the archive ends within its stream")


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a record's header, by lower-case name."""
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Whole records, with the empty lines after them, and their header fields; one record in memory at a time."""
    held, mark, done = bytearray(), END.encode(), False

    def more() -> bool:
        nonlocal done
        piece = next(pieces, None)
        done = piece is None
        if not done:
            held.extend(piece)
        return not done

    while held or more():
        at = held.find(mark)
        while at < 0:
            low = max(0, len(held) - 3)
            if not more():
                raise ValueError("the archive ends within a header")
            at = held.find(mark, low)
        if not held.startswith(b"WARC/"):
            raise ValueError("a record does not begin where the one before it ends")
        fields = header_fields(bytes(held[:at]))
        size = at + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        if held[size - 4 : size] != mark:
            raise ValueError("a record is not followed by two line ends")
        yield bytes(held[:size]), fields
        del held[:size]


def normalise_file(source: str, target: str) -> int:
    """Rewrite an archive with a member for each record, and its index as ``target`` + ``.idx``; the number of records."""
    n = offset = 0
    with opened(source) as file, written(target) as out, written(f"{target}.idx") as index:
        for record, fields in split_records(_inflated(file)):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = pack.compress(record) + pack.flush()
            out.write(member)
            line = {"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}
            index.write(json.dumps(line).encode() + b"\n")
            offset += len(member)
            n += 1
    return n


def archives(folder: str, ending: str) -> list[str]:
    """Files of a folder: as many as tasks wrote."""
    fs, path = pafs.FileSystem.from_uri(folder)
    root = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(root + f.path for f in found if f.is_file and f.path.endswith(ending))


def normalise(like: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise every archive of a folder, one task for each: ``path, n_records``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = f"{target}/{path.rpartition('/')[2].partition('.')[0]}.warc.gz"
                yield pa.RecordBatch.from_pydict({"path": [out], "n_records": [normalise_file(path, out)]})

    return stored(each_file(like, archives(source, ".gz")).mapInArrow(each, "path string, n_records long"))


def read_record(file: pa.NativeFile, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record in one member."""
    record = zlib.decompress(file.read_at(length, offset), 31)
    head, _, rest = record.partition(END.encode())
    fields = header_fields(head)
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(number) if number else None


def read_pages(files: DataFrame) -> DataFrame:
    """Every record of normalised archives, by its index: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``. A response's size and digest are those of its payload; a digest that differs from its header is an error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with opened(path) as file, opened(f"{path}.idx") as index:
                    for line in index.read().splitlines():
                        at = json.loads(line)
                        fields, block = read_record(file, at["offset"], at["length"])
                        http, _, payload = block.partition(END.encode())
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(header_fields(http)["content-length"])
                        if fields["warc-type"] == "response":
                            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if own != digest or size != len(payload):
                                raise ValueError(f"{at['id']} in {path} is damaged")
                        refers = _page(fields.get("warc-refers-to"))
                        rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], refers))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    listed = files.select("path").mapInArrow(each, ", ".join(f"{c} {k}" for c, k in (
        ("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"))))
    return listed


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as archives of one stream each, normalise them, and read every record through the indexes."""
    folder = work_folder(pages.sparkSession)
    write_monolithic(records(pages, page_id, url, html), f"{folder}/whole")
    done = normalise(pages, f"{folder}/whole", f"{folder}/members")
    return read_pages(each_file(pages, [r.path for r in done.select("path").collect()]))
