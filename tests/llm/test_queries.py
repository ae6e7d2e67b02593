"""The registered queries against their SQL, and each over its whole table."""

from __future__ import annotations

import pytest
from oracle_check import connect, difference

from spanmill.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n[2:4] in ("1_", "2_", "3_", "6_", "7_", "10", "12", "13")])
def test_every_document_is_answered(spark, name):
    want = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == want
