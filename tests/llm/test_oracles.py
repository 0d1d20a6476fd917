"""Queries that SQL can express against DuckDB, and the quality rules on odd rows."""

import pytest

from cloakwork.llm import cascade
from cloakwork.llm.registry import ORACLES, QUERIES
from tests.llm.conftest import rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tiny, duck, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_quality_of_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    made = [(1, None, True), (2, "", True), (3, good, False), (3, good, False), (None, good, True), (4, "ha! " * 30, True), (5, good + " #" * 9, False)]
    made += [(6, "one two three four five six seven eight nine " * 4000, True), (7, good + "\n" + good, False)]
    docs = spark.createDataFrame(made, "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in cascade.figures(docs).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[3].kept and got[None].kept and not got[4].kept and not got[5].kept and not got[5].base_failed
    assert got[6].n_repeat_words == 36_000 and got[7].n_repeat_words == 80 and got[7].n_dup_lines == 1
    kept = cascade.keep(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 3]
    assert cascade.figures(docs.limit(0)).collect() == [] and cascade.keep(docs.limit(0)).collect() == []


def test_order_changes_nothing(spark, tiny):
    from cloakwork.sources.tables import table

    docs = table(spark, tiny, "documents")
    order = cascade.rule_order(docs)
    assert sorted(order) == sorted(cascade.RULES)
    both = [docs.select("doc_id", cascade.verdict(o)("text").getField("kept").alias("k")).collect() for o in (order, order[::-1])]
    assert sorted(both[0]) == sorted(both[1])
