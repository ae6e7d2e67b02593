"""A cache is used again only for the same recipe over the same files, and only if it was finished."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from spanmill.sources.token_cache import TokenCache, cache_name


@pytest.fixture
def built():
    return []


def use(spark, tmp_path, built, recipe="bytes", settings=None, source="in"):
    def build(df):
        built.append(recipe)
        return df.select("id", F.length("text").alias("n"))

    cache = TokenCache(spark, str(tmp_path / "cache"))
    rows = cache.cached(spark.read.schema("id bigint, text string").parquet(str(tmp_path / source)), recipe, build, settings)
    return sorted((r["id"], r["n"]) for r in rows.collect())


def test_reused_rebuilt_and_told_apart(spark, tmp_path, built):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id bigint, text string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    want = [(1, 1), (2, 2), (3, None)]
    assert use(spark, tmp_path, built) == want == use(spark, tmp_path, built)
    assert built == ["bytes"]
    assert use(spark, tmp_path, built, settings={"length": 5}) == want == use(spark, tmp_path, built, settings={"length": 5})
    assert use(spark, tmp_path, built, recipe="letters") == want
    assert built == ["bytes", "bytes", "letters"]
    spark.createDataFrame([(4, "dddd")], "id bigint, text string").write.mode("append").parquet(str(tmp_path / "in"))
    assert use(spark, tmp_path, built) == [*want, (4, 4)] == use(spark, tmp_path, built)
    assert built[3:] == ["bytes"]


def test_a_touched_file_is_a_changed_input(spark, tmp_path, built):
    spark.createDataFrame([(1, "a")], "id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    use(spark, tmp_path, built)
    for path in glob.glob(str(tmp_path / "in" / "part-*")):
        os.utime(path, (10**9, 10**9))
    use(spark, tmp_path, built)
    assert len(built) == 2


def test_a_half_written_cache_is_ignored(spark, tmp_path, built):
    spark.createDataFrame([(1, "a")], "id bigint, text string").write.parquet(str(tmp_path / "in"))

    def fails(df):
        return df.select("id", F.raise_error(F.lit("lost")).cast("int").alias("n"))

    cache = TokenCache(spark, str(tmp_path / "cache"))
    source = spark.read.schema("id bigint, text string").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        cache.cached(source, "bytes", fails)
    assert cache.lookup(cache_name(source, "bytes")) is None
    spark.createDataFrame([(99, 99)], "id bigint, n int").write.parquet(str(tmp_path / "cache" / "data" / "left"))
    assert use(spark, tmp_path, built) == [(1, 1)] and built == ["bytes"]


def test_the_first_of_two_writers_wins(spark, tmp_path):
    cache = TokenCache(spark, str(tmp_path / "cache"))
    one, two = (spark.createDataFrame([(k,)], "id bigint") for k in (1, 2))
    assert [r["id"] for r in cache.commit("name", one).collect()] == [1] == [r["id"] for r in cache.commit("name", two).collect()]


def test_an_empty_table(spark, tmp_path, built):
    spark.createDataFrame([], "id bigint, text string").write.parquet(str(tmp_path / "in"))
    assert use(spark, tmp_path, built) == [] == use(spark, tmp_path, built) and len(built) == 1
