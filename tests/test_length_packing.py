"""Packing by the histogram of lengths: invariants, and its fill beside that of next-fit."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanmill.operators import length_packing as H
from spanmill.operators import packing as Z

LENGTHS = {"inputs": 20, "targets": 8}
SHORTEST = {"inputs": 1, "targets": 1}


@pytest.mark.parametrize("seed", range(30))
def test_a_plan_deals_all_and_overfills_nothing(seed):
    draw = random.Random(seed)
    capacity = (draw.randint(5, 60), draw.randint(3, 20))
    histogram = Counter((draw.randint(0, capacity[0]), draw.randint(1, capacity[1])) for _ in range(draw.randint(0, 400)))
    histogram = {size: n * draw.choice([1, 1, 50]) for size, n in histogram.items()}
    dealt, content = Counter(), {}
    for d in H.plan(histogram, capacity):
        assert d.first == dealt[d.size]
        dealt[d.size] = d.last
        for rank in range(d.first, d.last):
            content.setdefault(d.pack + (rank - d.first) // d.times, []).append(d.size)
    assert dict(dealt) == {s: n for s, n in histogram.items() if n}
    assert all(sum(s[k] for s in pack) <= capacity[k] for pack in content.values() for k in (0, 1))
    assert sorted(content) == list(range(len(content)))


def test_many_lengths_are_rounded_up():
    found, grain = H.coarsened({(k, k % 7): 2 for k in range(1000)}, classes=200)
    assert len(found) <= 200 and sum(found.values()) == 2000 and grain > 1
    assert all(k % grain == 0 for size in found for k in size)


def examples(spark, n: int = 600):
    draw = random.Random(8)
    rows = [(k, [k + 1] * draw.choice([1, 2, 3, 5, 8, 13, 19, 20, 25]), [7] * draw.randint(1, 6)) for k in range(n)]
    rows += [(n, [3] * 20, [1] * 8), (n + 1, [3], [1])]
    return rows, spark.createDataFrame(rows, "id bigint, inputs array<int>, targets array<int>")


@pytest.mark.parametrize("classes", [H.CLASSES, 10])
def test_no_token_is_lost_and_partitions_do_not_matter(spark, monkeypatch, classes):
    monkeypatch.setattr(H, "CLASSES", classes)
    monkeypatch.setattr(H.coarsened, "__defaults__", (classes,))
    rows, df = examples(spark)
    results = set()
    for n in (1, 4, 8):
        packs = H.pack_by_lengths(df.repartition(n), ["id"], lengths=LENGTHS, shortest=SHORTEST, ensure_eos=False).collect()
        results.add(tuple(sorted(map(repr, packs))))
    assert len(results) == 1
    ids = {k: (inputs[:20], targets[:8]) for k, inputs, targets in rows}
    seen = []
    for r in packs:
        for feature, length in LENGTHS.items():
            assert len(r[feature]) == len(r[f"{feature}_segmentation"]) == len(r[f"{feature}_position"]) == length
            want = [v for m in r["members"] for v in ids[m["id"]][feature == "targets"]]
            segments = [s for s, m in enumerate(r["members"], 1) for _ in ids[m["id"]][feature == "targets"]]
            places = [p for m in r["members"] for p in range(len(ids[m["id"]][feature == "targets"]))]
            pad = [0] * (length - len(want))
            assert (r[feature], r[f"{feature}_segmentation"], r[f"{feature}_position"]) == (want + pad, segments + pad, places + pad)
        seen += [m["id"] for m in r["members"]]
    assert sorted(seen) == sorted(ids)


def test_fill_beside_next_fit(spark):
    _, df = examples(spark, 3000)
    packs = H.pack_by_lengths(df, ["id"], lengths=LENGTHS, shortest=SHORTEST)
    ours = H.fill_rate(packs, LENGTHS).first()
    theirs = H.fill_rate(Z.pack_examples(df, ["id"], F.floor(F.col("id") / 100), LENGTHS, SHORTEST), LENGTHS).first()
    assert ours["packs"] < 0.9 * theirs["packs"] and ours["inputs_filled"] > 1.1 * theirs["inputs_filled"]
    back = H.unpacked(packs, ["inputs", "targets"])
    assert back.count() == 3002
    assert back.where("size(inputs) = 0 or size(targets) = 0").count() == 0


def test_ends_and_empty_table(spark):
    _, df = examples(spark)
    assert H.pack_by_lengths(df.limit(0), ["id"]).count() == 0
    longest = spark.createDataFrame([(1, [9] * 30, [9] * 30)], df.schema)
    r = H.pack_by_lengths(longest, ["id"], lengths=LENGTHS).first()
    assert r["inputs"] == [9] * 19 + [1] and r["targets"] == [9] * 7 + [1]
