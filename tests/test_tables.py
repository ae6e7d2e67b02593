"""Recipes called from SQL text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanmill.plans.recipes import registry
from spanmill.plans.tables import RECIPES, register_tables

CALL = "SELECT * FROM masked_pairs(TABLE(SELECT * FROM {t}) PARTITION BY group_id ORDER BY (record_no), '%s')"


@pytest.fixture(scope="module")
def records(spark):
    register_tables(spark)
    texts = ["가힣 abc " * 60, "", None, "é🙂漢" * 500, "x", *(f"text {k} " * (k % 90) for k in range(250)), "가" * 40_000]
    return spark.createDataFrame(list(enumerate(texts)), "record_no bigint, text string").repartition(3)


@pytest.mark.parametrize("recipe", list(RECIPES))
def test_equals_the_recipe(spark, records, recipe):
    grouped = records.selectExpr("record_no div 128 AS group_id", "record_no", "text", "'clash' AS segment")
    found = spark.sql(CALL % recipe, t=grouped).collect()
    want = registry.recipe(recipe).run(records).collect()
    key = lambda r: (r["group_id"], r["segment"], r["inputs"], r["targets"])
    assert sorted(map(key, found)) == sorted(map(key, want)) and len(want) > 30


@pytest.mark.parametrize(
    "call, message",
    [
        ("SELECT * FROM masked_pairs(TABLE(SELECT * FROM {t}) PARTITION BY (group_id), 'nothing')", "no recipe nothing"),
        ("SELECT * FROM masked_pairs(TABLE(SELECT 1 AS group_id), 'bytes_ascending')", "lacks record_no, text"),
        ("SELECT * FROM masked_pairs(1, 'bytes_ascending')", "must be a table"),
        ("SELECT * FROM masked_pairs(TABLE(SELECT * FROM {t}), 'bytes_ascending')", "partitioned by group_id"),
    ],
)
def test_wrong_calls(spark, records, call, message):
    grouped = records.selectExpr("record_no % 5 AS group_id", "record_no", "text")
    with pytest.raises(Exception, match=message):
        spark.sql(call, t=grouped).collect()


def test_empty_table(spark, records):
    grouped = records.withColumn("group_id", F.lit(0).cast("bigint")).limit(0)
    assert spark.sql(CALL % "bytes_ascending", t=grouped).count() == 0


def test_examples_come_back_as_arrow(spark, records):
    grouped = records.selectExpr("record_no div 128 AS group_id", "record_no", "text")
    plan = spark.sql(CALL % "letters_ascending", t=grouped)._jdf.queryExecution().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan
