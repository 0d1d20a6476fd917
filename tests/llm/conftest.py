import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    yield con
    con.close()


def rows(frame, *columns):
    """Rows of a pandas or Spark frame as sorted tuples."""
    frame = frame.toPandas() if hasattr(frame, "toPandas") else frame
    cells = frame[list(columns) or sorted(frame.columns)].astype(object)
    return sorted((tuple(None if v is None or v != v else v for v in row) for row in cells.itertuples(index=False)), key=repr)
