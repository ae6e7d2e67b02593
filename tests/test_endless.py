"""Endless epochs and the streaming shuffle against plain simulations, over stops and restarts."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanmill.streaming import epochs as O
from spanmill.streaming import jobs as T
from spanmill.streaming import shuffle as U


def md5(*parts: object) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_epochs_go_on_after_restarts(spark, tmp_path):
    rows = [(k if k % 9 else None, f"t{k}" if k % 5 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    O.write_shards(df, f"{tmp_path}/in", ["text", "id"], rows_per_shard=32)
    sizes = {r["shard"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/in/sizes").collect()}
    assert len(sizes) == 16 and sum(sizes.values()) == 400
    for last in (0, 1, 1, 2):  # the third run only finds what is there
        stream = O.stream_epochs(spark, f"{tmp_path}/in", "id bigint, text string", shardsPerTrigger=7)
        T.run_until(stream, f"{tmp_path}/out", f"{tmp_path}/state", F.max("epoch") > last)
    found = spark.read.parquet(f"{tmp_path}/out").where("epoch < 3").collect()
    by_epoch: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["epoch"], r["pos"])):
        assert r["pos"] == len(by_epoch.setdefault(r["epoch"], []))
        by_epoch[r["epoch"]].append((r["id"], r["text"]))
    assert all(Counter(by_epoch[e]) == Counter(rows) for e in range(3))
    assert by_epoch[0] != by_epoch[1] != by_epoch[2]


def test_epochs_that_end_and_an_empty_table(spark, tmp_path):
    df = spark.range(100).toDF("id")
    for name, rows, total in (("some", df, 200), ("none", df.limit(0), 0)):
        O.write_shards(rows, f"{tmp_path}/{name}", ["id"], rows_per_shard=10)
        stream = O.stream_epochs(spark, f"{tmp_path}/{name}", "id bigint", epochs=2)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option(
            "checkpointLocation", f"{tmp_path}/{name}-state"
        ).start()
        query.processAllAvailable()
        query.stop()
        out = spark.read.schema("id bigint, epoch bigint, pos bigint").parquet(f"{tmp_path}/{name}-out")
        assert (out.count(), out.select("epoch", "pos").distinct().count()) == (total, total)


def simulated(ids: list[int], lanes: int, size: int) -> list[tuple[int, int, int]]:
    held: dict[int, list[int]] = {}
    seen: Counter = Counter()
    out = []
    for k in ids:
        lane = int(md5(1, "lane", k)[:8], 16) % lanes
        own, n = held.setdefault(lane, []), seen[lane]
        if n < size:
            own.append(k)
        else:
            slot = int(md5(1, "slot", lane, n)[:8], 16) % size
            out.append((lane, n - size, own[slot]))
            own[slot] = k
        seen[lane] += 1
    for lane, own in held.items():
        order = sorted(range(len(own)), key=lambda s: (int(md5(1, "end", lane, s)[:8], 16), s))
        out += [(lane, seen[lane] - len(own) + k, own[s]) for k, s in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("cuts", [[0, 250], [0, 3, 100, 250]])
def test_shuffle_equals_a_simulation_however_it_is_cut(spark, tmp_path, cuts):
    df = spark.range(250).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('é"\n'), "id")).alias("text"))
    U.end_lanes(spark, f"{tmp_path}/ends", lanes=0)
    for low, high in zip([*cuts, None], [*cuts[1:], None, None]):
        if high is not None:
            df.where((F.col("id") >= low) & (F.col("id") < high)).write.mode("append").parquet(f"{tmp_path}/in")
        elif low is None:
            U.end_lanes(spark, f"{tmp_path}/ends", lanes=3)
        else:
            continue
        arriving = T.stream_table(spark, f"{tmp_path}/in", "id bigint, text string")
        ends = T.stream_table(spark, f"{tmp_path}/ends", "lane bigint")
        stream = U.shuffle_stream(arriving, ends, ["id"], "id", size=20, lanes=3)
        U.run_with_state(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["lane"], r["pos"], r["id"]) for r in out.collect()) == simulated(list(range(250)), 3, 20)
    assert out.select("id", "text").exceptAll(df).count() == 0 and out.count() == 250


def test_small_shards_share_folders_and_tasks(spark, tmp_path):
    O.write_shards(spark.range(900).toDF("id"), f"{tmp_path}/in", ["id"], rows_per_shard=4)
    reader = O.EpochReader(O.StructType.fromDDL("id bigint, epoch bigint, pos bigint"), {"path": f"{tmp_path}/in", "shardspertrigger": "100"})
    assert len(reader.sizes) > 200
    parts = reader.partitions(reader.initialOffset(), {"epoch": 1, "shard": 20})
    assert len(parts) == 2  # one folder, in two epochs
    found = [tuple(r.values()) for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    order, digest = reader.order(0), lambda e, k: (md5(1, "epoch", e, k), str(k))
    expected = []
    for epoch, shards in ((0, order), (1, reader.order(1)[:20])):
        ids = [k for s in shards for k in sorted((k for k in range(900) if f"s{md5(1, 'shard', k)[:2]}" == s.name), key=lambda k: digest(epoch, k))]
        expected += [(k, epoch, pos) for pos, k in enumerate(ids)]
    assert sorted(found, key=lambda r: r[1:]) == expected
