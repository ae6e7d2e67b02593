"""Connected components of a table of links.

Links are first contracted in chunks of ``CHUNK``: a task joins the nodes of its chunk to stars around the least of each.
What one chunk holds is done by that. Several chunks go on by alternating large stars and small stars until nothing
changes. Each round is aggregations and joins on the links alone: a node with very many links is summed before the
shuffle, and its join is one that the adaptive plan may split. Rounds are written to the shared folder, so no plan grows
and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import written

CHUNK = 1 << 18
LINKS = "a bigint, b bigint"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, root`` of every node of the links but the roots; the root is the least node of the component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(k) for k in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(links: DataFrame, chunks: int) -> DataFrame:
    """Stars with the components of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) >= CHUNK:
                a, b = stars(a, b)
        node, root = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    return links.repartition(chunks).mapInArrow(run, LINKS)


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` but the roots; the root is the least node that can be reached.

    Null ends and links of a node to itself are left out; an empty table gives an empty table.
    """
    now = written(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b"), "links")
    chunks = max(1, -(-now.count() // CHUNK))
    now = written(contracted(now, chunks), "links")
    state = None
    while chunks > 1:
        now = written(_small_star(_large_star(now)), "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
