"""Binary files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.texts import id_and_keys


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator[pa.NativeFile]:
    """A file that appears under its name when it is complete; a task that is run again replaces it."""
    fs, path = _at(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft, compression=None) as out:
        yield out
    fs.move(draft, path)


def opened(uri: str) -> pa.NativeFile:
    """A file to be read at any place."""
    fs, path = _at(uri)
    return fs.open_input_file(path)


def id_bounds(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Cuts between ``n`` ranges of about as many ids. They shape the files; any cuts give the same order."""
    ids = docs.select(id_and_keys(doc_id, text)[0])
    cuts = ids.approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return np.unique(np.array(cuts, np.float64))


def range_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each id; never smaller for a larger id."""
    return np.searchsorted(bounds, ids.astype(np.float64), side="right").astype(np.int32)


#: A range has about so many bytes of the input at most.
RANGE_BYTES = 512 << 20


def width(spark_frame: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, and more where that would make them too large."""
    size = int(str(spark_frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan whose size Spark cannot tell has one beyond all sizes
    known = size if size < 1 << 60 else 0
    return max(int(spark_frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // RANGE_BYTES))


def starts(totals: DataFrame, order: str, amount: str) -> list[tuple]:
    """Rows of a table that has one row for each file, with the sum of ``amount`` before each in ``order``."""
    out, before = [], 0
    for row in totals.orderBy(F.col(order)).collect():
        out.append((*row, before))
        before += row[amount]
    return out


def each_file(like: DataFrame, rows: list) -> DataFrame:
    """A row for each file, dealt out evenly: one task for each."""
    spark = like.sparkSession
    numbered = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    kinds = "i long, path string" + "".join(f", c{k} long" for k in range(len(numbered[0]) - 2)) if numbered else "i long, path string, c0 long"
    frame = spark.createDataFrame(numbered, kinds)
    return frame.repartitionById(max(1, len(rows)), F.col("i").cast("int")).drop("i")
