"""Approximate nearest neighbours with a robust-pruned directed graph for each shard.

Vectors are dealt out to shards of about ``SHARD`` by a hash of their rows. A shard builds its graph in growing batches:
greedy beam searches over the graph so far propose neighbours, pruning keeps a neighbour only if no kept one is closer to
it by the factor ``ALPHA``, and edges back are added and pruned alike. Graphs are written to the shared folder.

A query is searched in every shard: a beam walks the graph from the shard's middle, the best found are measured in double
precision on the original vectors, and the best of all shards are its answer. Queries come in blocks of ``BLOCK``; a block
is broadcast, so what is sent at once does not grow with the table.

Equal vectors are one node with the list of their ids, so a vector that a third of all rows share costs no more than one.

Defined cases: rows whose vector is null, zero, or holds a null or a component that is not finite take no part, and
neither do rows without an id. Of equally near vectors the one with the smaller id comes first. Vectors are compared with those of the same length only. Repeated rows count once. Fewer
candidates than asked for give fewer answers; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.session import written

SHARD = 4096
DEGREE = 24
BEAM = 64
ALPHA = 1.2
WIDTH = 4
BATCH = 256
BLOCK = 4096
GRAPHS = "dim int, n int, vectors binary, edges binary, entry int, ids binary, starts binary"
FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def distances(points: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of ``points[rows]`` (batch x k) to ``to`` (batch x dim)."""
    apart = points[rows] - to[:, None, :]
    return np.einsum("bkd,bkd->bk", apart, apart)


def search(points: np.ndarray, edges: np.ndarray, entry: int, to: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """``rows, squared distances`` of the nearest that a beam search finds for each of ``to``, nearest first; -1 where none."""
    many = len(to)
    each = np.arange(many)[:, None]
    rows = np.full((many, beam), -1, dtype=np.int64)
    away = np.full((many, beam), np.inf, dtype=points.dtype)
    rows[:, 0] = entry
    away[:, 0] = distances(points, rows[:, :1], to)[:, 0]
    fresh = np.zeros((many, beam), dtype=bool)
    fresh[:, 0] = True
    seen = np.zeros((many, len(points) + 1), dtype=bool)  # the last column takes what is no row
    seen[:, entry] = seen[:, -1] = True
    while fresh.any():
        order = np.argsort(np.where(fresh, away, np.inf), axis=1)[:, :WIDTH]
        chosen = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(rows, order, 1), -1)
        np.put_along_axis(fresh, order, False, axis=1)
        near = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(many, -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[each, near]] = -1
        seen[each, near] = True
        far = np.where(near >= 0, distances(points, near, to), np.inf)
        rows, away = np.concatenate([rows, near], axis=1), np.concatenate([away, far], axis=1)
        fresh = np.concatenate([fresh, near >= 0], axis=1)
        best = np.argpartition(away, beam - 1, axis=1)[:, :beam]
        rows, away, fresh = (np.take_along_axis(x, best, 1) for x in (rows, away, fresh))
        fresh &= away < np.inf
    order = np.argsort(away, axis=1, kind="stable")
    rows, away = np.take_along_axis(rows, order, 1), np.take_along_axis(away, order, 1)
    return np.where(away < np.inf, rows, -1), away


def pruned(points: np.ndarray, of: np.ndarray, rows: np.ndarray, away: np.ndarray, degree: int) -> np.ndarray:
    """For each point ``of``, at most ``degree`` of its candidates ``rows``, which come nearest first; -1 where none.

    A candidate goes if one that is kept is closer to it, by the factor ``ALPHA``, than the point is.
    """
    own = np.where(rows >= 0, rows, of[:, None])
    x = points[own]
    squares = np.einsum("bkd,bkd->bk", x, x)
    between = np.maximum(squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
    alive = (rows >= 0) & (rows != of[:, None])
    kept = np.full((len(of), degree), -1, dtype=np.int64)
    count = np.zeros(len(of), dtype=np.int64)
    for k in range(rows.shape[1]):
        take = alive[:, k] & (count < degree)
        kept[take, count[take]] = rows[take, k]
        count += take
        alive &= ~(take[:, None] & (ALPHA**2 * between[:, k, :] <= away))
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """The edges of a graph over distinct points (n x degree, -1 where none), and the point where searches begin."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    middle = points.mean(axis=0)
    entry = int(np.argmin(((points - middle) ** 2).sum(axis=1)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done, size = 1, 1
    while done < n:
        batch = order[done : done + size]
        rows, away = search(points, edges, entry, points[batch], beam)
        edges[batch] = pruned(points, batch, rows, away, degree)
        # Edges back: each target gets its old edges and the new ones, and is pruned if they are too many.
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order_in = np.argsort(target, kind="stable")
        source, target = source[order_in], target[order_in]
        hit, first, many = np.unique(target, return_index=True, return_counts=True)
        width = degree + int(many.max(initial=0))
        merged = np.full((len(hit), width), -1, dtype=np.int64)
        merged[:, :degree] = edges[hit]
        merged[np.repeat(np.arange(len(hit)), many), degree + np.arange(len(target)) - np.repeat(first, many)] = source
        merged = np.sort(merged, axis=1)
        merged[:, 1:][merged[:, 1:] == merged[:, :-1]] = -1
        for part in np.array_split(np.arange(len(hit)), 1 + len(hit) * width // (BATCH * 2 * BEAM)):
            far = np.where(merged[part] >= 0, distances(points, merged[part], points[hit[part]]), np.inf)
            near = np.argsort(far, axis=1, kind="stable")
            rows, far = np.take_along_axis(merged[part], near, 1), np.take_along_axis(far, near, 1)
            full = (rows >= 0).sum(axis=1) > degree
            edges[hit[part[~full]]] = rows[~full, :degree]
            if full.any():
                edges[hit[part[full]]] = pruned(points, hit[part[full]], rows[full], far[full], degree)
        done += len(batch)
        size = min(2 * size, BATCH)
    return edges, entry


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part, repeated rows once."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))

    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.where(F.forall("vector", sound) & F.exists("vector", lambda x: x != 0)).distinct()


def graphs(rows: DataFrame) -> DataFrame:
    """One row of ``GRAPHS`` for each shard of ``rows(vec_id, vector)``."""
    rows = written(rows.withColumn("dim", F.size("vector")), "vectors")
    shards = {r["dim"]: -(-r["count"] // SHARD) for r in rows.groupBy("dim").count().collect()}
    if not shards:
        return rows.sparkSession.createDataFrame([], GRAPHS)
    many = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.try_element_at(many, F.col("dim")).cast("bigint"))

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("dim")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        points, node = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        starts = np.searchsorted(node.ravel()[order], np.arange(len(points) + 1))
        edges, entry = build(points)
        values = [dim, len(points), points.tobytes(), edges.astype(np.int32).tobytes(), entry, ids[order].tobytes(), starts.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in GRAPHS.split(", ")])

    return written(rows.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(make, GRAPHS), "graphs")


def answers(made: DataFrame, queries: list[tuple[int, int, list[float]]], k: int, beam: int) -> DataFrame:
    """The ``k`` nearest that each shard finds for each of a block of queries ``(number, id, vector)``."""
    shared = made.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, n, vectors, edges, entry, ids, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = [q for q in shared.value if len(q[2]) == dim]
                points = np.frombuffer(vectors).reshape(n, dim)
                graph = np.frombuffer(edges, np.int32).reshape(n, -1).astype(np.int64)
                ids, starts = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)
                for start in range(0, len(asked), BATCH):
                    some = asked[start : start + BATCH]
                    to = np.array([q[2] for q in some])
                    rows, _ = search(points, graph, entry, to, max(beam, k + 1))
                    out = []
                    for (number, own, _), v, found in zip(some, to, rows, strict=True):
                        found = found[found >= 0]
                        exact = np.sqrt(((points[found] - v) ** 2).sum(axis=1))
                        best = []
                        for d, row in sorted(zip(exact.tolist(), found.tolist(), strict=True)):
                            if len(best) >= k and d > best[-1][0]:
                                break
                            some_ids = ids[starts[row] : min(starts[row] + k + 1, starts[row + 1])]  # the least ids of a node
                            best = sorted([*best, *((d, i) for i in some_ids.tolist() if i != own)])[:k]
                        out += [(number, own, i, d) for d, i in best]
                    columns = list(zip(*out)) or [[]] * 4
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "query_id", "vec_id", "score"]
                    )

    return made.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows to every row for which ``queries`` (over vec_id) holds."""
    rows = usable(vectors, vec_id, embedding)
    made = graphs(rows)
    asked = written(rows.where(queries).withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = -(-asked.count() // BLOCK)
    found = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)
        some = [(r["number"], r["vec_id"], list(r["vector"])) for r in block.select("number", "vec_id", "vector").collect()]
        part = answers(made, some, k, beam)
        part = written(part, "answers") if blocks > 1 else part
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
