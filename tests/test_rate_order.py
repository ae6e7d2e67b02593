"""Places of a mixture: every prefix keeps the rates."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest

from spanmill.operators import mixing as X


@pytest.mark.parametrize("seed", range(20))
def test_no_prefix_of_a_pattern_is_off_by_a_row(seed):
    draw = random.Random(seed)
    weights = {f"s{k}": draw.randint(1, 60 if draw.random() < 0.7 else 1) for k in range(draw.randint(1, 25))}
    places, period, seen = X.rate_pattern(weights), sum(weights.values()), Counter()
    for n, name in enumerate(places, 1):
        seen[name] += 1
        assert all(abs(seen[s] - Fraction(n * w, period)) < 1 for s, w in weights.items())
    assert seen == weights


def test_rates_are_shares():
    assert X.normalized({"a": 1, "b": 1}) == {"a": 1, "b": 1}
    assert X.normalized({"a": 0.7, "b": 0.3}) == {"a": 7, "b": 3} == X.normalized({"a": 70, "b": 30})
    odd = X.normalized({"a": 1 / 3, "b": 1e-9, "c": 0.123456789})
    assert sum(odd.values()) <= X.RESOLUTION + 1 and odd["b"] == 1
    for rates in ({}, {"a": 0}, {"a": -1, "b": 2}):
        with pytest.raises(ValueError):
            X.normalized(rates)


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_rows_take_their_places(spark, partitions):
    rows = [(k, "abc"[0 if k % 3 else 1 + k % 2], "x") for k in range(300)] + [(900 + k, "unnamed", "x") for k in range(50)]
    df = spark.createDataFrame(rows, "id bigint, source string, epoch_of string").repartition(partitions)
    rates, total = {"a": 2, "b": 1, "c": 4, "gone": 1}, 1003
    found = sorted(X.mix_in_rate_order(df, "source", ["id"], rates, total).collect(), key=lambda r: r["pos"])
    places = [s for s in X.rate_pattern(X.normalized(rates)) * 200][:total]
    assert [(r["pos"], r["source"]) for r in found] == [(k, s) for k, s in enumerate(places) if s != "gone"]
    sizes = Counter(s for _, s, _ in rows)
    order: dict[str, list[int]] = {}
    for r in found:
        order.setdefault(r["source"], []).append(r["id"])
        assert r["epoch"] == (len(order[r["source"]]) - 1) // sizes[r["source"]]
    for source, ids in order.items():
        first = ids[: sizes[source]]
        assert len(set(first)) == len(first)
        assert ids == [first[k % len(first)] for k in range(len(ids))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, source string")
    assert X.mix_in_rate_order(df, "source", ["id"], {"a": 1}, 10).count() == 0
