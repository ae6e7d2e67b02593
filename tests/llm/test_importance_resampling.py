"""Weights, scores and ranks against a plain computation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from spanmill.llm import importance_resampling as resampling
from spanmill.llm.catalog import QUERIES
from spanmill.session import scratch

SCHEMA = "doc_id bigint, text string, score string, run string, at string, segment string"
SF = "/root/testdata/sf0.001"


def buckets(text: str | None) -> tuple[list[int], int]:
    data = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", data)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [zlib.crc32(r.encode()) % 10_000 for r in runs], len(words)


def plain(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    own = [(doc, *buckets(text)) for doc, text in docs]
    s, t = Counter(), Counter()
    for _, found, _ in own:
        s.update(found)
    for text in target:
        t.update(buckets(text)[0])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc, found, n in own:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 25 * len(able) // 100
    found = [(*r[:4], k if k <= drawn else None) for k, r in enumerate(able, 1)]
    return sorted(found + [(*r[:4], None) for r in rows if r[4] < 20], key=repr)


def documents() -> list[tuple]:
    rng = random.Random(5)
    words = ["Ab", "é", "日本", "x-y", "7", "a'b", *(f"w{k}" for k in range(400))]
    found = [(k if k % 50 else None, " ".join(rng.choices(words, k=rng.choice([0, 5, 25, 60])))) for k in range(1500)]
    found += [(3, None), (4, ""), (5, "one"), (6, "a b " * 700_000)]
    return found + [found[25]] * 900  # a third of all rows are one row


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_equals_plain_computation(spark, partitions):
    docs, target = documents(), ["w1 w2 w3 w1 w2", None, "", "Ab é w7 " * 50]
    frame = spark.createDataFrame([(*d, "clash", "clash", "clash", "clash") for d in docs], SCHEMA).repartition(partitions)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = sorted((tuple(r) for r in resampling.resampled(frame, goal).collect()), key=repr)
    assert found == plain(docs, target)


def test_segments_are_even_with_one_row_a_third(spark, monkeypatch):
    written_segments = []

    def written(frame, name):
        path = scratch(spark, name)
        frame.write.parquet(path)
        written_segments.append(path)
        return spark.read.parquet(path)

    monkeypatch.setattr(resampling, "written", written)
    docs = documents()
    rows = spark.createDataFrame([(d, 1, 1, 1 if k > 1500 else k) for k, (d, _) in enumerate(docs)], "doc_id bigint, n_features bigint, weight bigint, score bigint")
    found = resampling.ranked(rows.repartition(8)).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, len(docs) + 1))
    ordered = [r["score"] for r in sorted(found, key=lambda r: r["rank"])]
    assert ordered == sorted(ordered, reverse=True)
    sizes = Counter(r["segment"] for r in spark.read.parquet(str(written_segments[-1])).collect())
    assert max(sizes.values()) <= 2 * len(docs) / 8


def test_empty_tables(spark):
    frame = spark.createDataFrame([(*d, "", "", "", "") for d in documents()[:40]], SCHEMA)
    goal = spark.createDataFrame([("w1 w2",)], "text string")
    assert resampling.resampled(frame.limit(0), goal).count() == 0
    found = sorted((tuple(r) for r in resampling.resampled(frame, goal.limit(0)).collect()), key=repr)
    assert found == plain(documents()[:40], [])


def test_query_equals_plain_computation(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    want = plain([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])
    assert sorted((tuple(r) for r in QUERIES["op13_importance_resampling"](spark, SF).collect()), key=repr) == want
