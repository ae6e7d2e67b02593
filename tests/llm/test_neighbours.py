"""Recall against all distances, exact scores, and the defined cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import neighbours as nn
from spanmill.llm.catalog import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank string"


def exact(ids: np.ndarray, x: np.ndarray, own: int, v: np.ndarray, k: int = 10) -> list[tuple[float, int]]:
    d = np.sqrt(((x - v) ** 2).sum(axis=1))
    return sorted((a, b) for a, b in zip(d.tolist(), ids.tolist(), strict=True) if b != own)[:k]


@pytest.mark.parametrize(("sf", "shard"), [("sf0.1", nn.SHARD), ("sf0.1", 300), ("sf0.01", 64)])
def test_recall(spark, monkeypatch, sf, shard):
    monkeypatch.setattr(nn, "SHARD", shard)
    monkeypatch.setattr(nn, "BLOCK", 7 if shard == 64 else nn.BLOCK)
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    found: dict[int, list] = {}
    for r in QUERIES["op9_nearest_neighbours"](spark, path).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        v = x[np.flatnonzero(ids == q)[0]]
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        for _, score, i in got:
            assert abs(score - np.sqrt(((x[np.flatnonzero(ids == i)[0]] - v) ** 2).sum())) < 1e-12 and i != q
        hits += len({g[2] for g in got} & {b for _, b in exact(ids, x, q, v)})
    assert hits >= 0.95 * 10 * len(found)


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0])]
    rows += [(200, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (300, [1.0, 2.0, 3.0]), (8, [])]
    vectors = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = sorted(map(tuple, nn.nearest(vectors, F.col("vec_id") % 100 == 0, k=3).collect()))
    far, root = 5**0.5, 2**0.5
    assert got == [
        (0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, root), (100, 1, 3, 1.0), (100, 2, 0, root), (100, 3, 1, root),
    ]
    assert nn.nearest(vectors, F.col("vec_id") == 3, k=9).count() == 4 and far > root
    assert nn.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_a_vector_that_most_rows_share(spark):
    rows = [(k, [0.5, 0.25, 1.0]) for k in range(3000)] + [(k, [float(k % 7), 1.0, float(k)]) for k in range(3000, 3300)]
    vectors = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = nn.nearest(vectors, F.col("vec_id") % 100 == 0).where("query_id < 3000").orderBy("query_id", "rank").collect()
    assert len(got) == 30 * 10
    for r in got:
        want = [k for k in range(11) if k != r["query_id"]][r["rank"] - 1]
        assert (r["vec_id"], r["score"]) == (want, 0.0)


def test_graph_reaches_every_node():
    points = np.random.default_rng(0).normal(size=(700, 8))
    edges, entry = nn.build(points)
    reached, todo = {entry}, [entry]
    while todo:
        for k in edges[todo.pop()]:
            if k >= 0 and k not in reached:
                reached.add(int(k))
                todo.append(int(k))
    assert len(reached) > 0.99 * len(points) and (edges >= 0).sum(axis=1).max() <= nn.DEGREE
