"""Mixtures of named tasks with numbers and functions as rates."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanmill.operators.mixing import normalized, rate_pattern
from spanmill.plans import jobs
from spanmill.plans.recipes import Recipe, Registry, keyed, registry, temperature_rate


def test_shares():
    r = Registry()
    r.add_mixture("numbers", {"a": 1, "b": 1, "c": 2})
    assert r.shares("numbers", {"a": 5, "b": 1, "c": 9}) == {"a": 0.25, "b": 0.25, "c": 0.5}
    assert r.shares("numbers", {"a": 5, "c": 0}) == {"a": 1.0}
    r.add_mixture("by size", ["a", "b"], temperature_rate(2.0, maximum=100))
    assert r.shares("by size", {"a": 10_000, "b": 25}) == {"a": 10 / 15, "b": 5 / 15}
    r.add_mixture("both", {"a": 3, "b": lambda name, count: count})
    assert r.shares("both", {"a": 7, "b": 1}) == {"a": 0.75, "b": 0.25}
    with pytest.raises(ValueError):
        r.add_mixture("both", ["a"])
    assert registry.mixture("korean_english") == {"ko": 0.7, "en": 0.3}


def test_examples_in_rate_order(spark):
    def cut(size):
        parts = F.posexplode(F.regexp_extract_all("targets", F.lit(f".{{1,{size}}}"), F.lit(0)))
        return lambda df: df.select(F.col("record_no").alias("group_id"), parts.alias("segment", "targets"), "inputs")

    r = Registry()
    for name, size in (("short", 2), ("long", 5)):
        r.add(Recipe(name, (keyed, cut(size))))
    r.add_mixture("m", ["short", "long"], lambda name, count: count if name == "short" else 2 * count)
    corpus = spark.createDataFrame([(k, "x" * 20) for k in range(6)], "record_no bigint, text string")
    found = sorted(jobs.mixture_examples("m", {"short": corpus, "long": corpus}, registered=r).collect(), key=lambda x: x["pos"])
    assert [x["pos"] for x in found] == list(range(84))  # 60 and 24 examples at 60 to 48
    places = rate_pattern(normalized(r.shares("m", {"short": 60, "long": 24}))) * 10
    assert [x["task"] for x in found] == places[:84]
    seen = Counter((x["task"], x["epoch"]) for x in found)
    assert seen["long", 0] == 24 and seen["long", 1] > 0 and seen["short", 1] == 0
    assert {len(x["targets"]) for x in found if x["task"] == "long"} == {5}
    empty = {"short": corpus.limit(0), "long": corpus.limit(0)}
    assert jobs.mixture_examples("m", empty, registered=r).count() == 0
