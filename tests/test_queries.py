"""Every registered query against its DuckDB counterpart, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from cloakwork.plans.oracle_queries import ORACLES
from cloakwork.plans.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    yield con
    con.close()


def rows_of(frame):
    def cell(v):
        return None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def test_every_query_has_a_counterpart():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, tiny, duck, name):
    got = entry_module.queries()[name](spark, tiny).toPandas()
    want = duck.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["doc_id", "masked_text", "n_entities"]
