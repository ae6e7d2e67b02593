"""A seeded shuffle of a stream through bounded buffers.

Records are dealt to lanes by the digest of their keys, so lanes are even whatever the sources look like. Each lane keeps ``size``
records as keyed state. Once it is full, a record that arrives takes the place of one that a seeded draw chooses, and that one
is released. An end mark for the lane releases what is left, in a seeded order, so no record is lost.

What a lane releases depends on the records' order alone and not on how they are split into micro-batches: a micro-batch is
taken in the order of the ``order`` column, and draws depend on seed, lane and count. State is read and written by the slot.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanmill.functions.draws import draw

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 1024
LANES = 64
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = (1 << 63) - 1


def _draw(*parts: object) -> int:
    """As :func:`spanmill.functions.draws.draw`, for values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


class Buffer(StatefulProcessor):
    """``lane, pos, row`` from ``lane, at, row, last``."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")
        self.slots = handle.getMapState("slots", "slot int", "row string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        lane, size = int(key[0]), self.size
        arrived = pd.concat(list(rows)).sort_values(["at", "row"], kind="stable")
        n = self.seen.get()[0] if self.seen.exists() else 0
        changed: dict[int, str] = {}
        released: list[tuple[int, str]] = []

        def held(slot: int) -> str:
            return changed[slot] if slot in changed else self.slots.getValue((slot,))[0]

        for row in arrived.loc[~arrived["last"], "row"]:
            slot = n
            if n >= size:
                slot = _draw(self.seed, "slot", lane, n) % size
                released.append((n - size, held(slot)))
            changed[slot] = row
            n += 1
        if arrived["last"].any():
            full = min(n, size)
            order = sorted(range(full), key=lambda slot: (_draw(self.seed, "end", lane, slot), slot))
            released += [(n - full + k, held(slot)) for k, slot in enumerate(order)]
            self.slots.clear()
            self.seen.clear()
        else:
            for slot, row in changed.items():
                self.slots.updateValue((slot,), (row,))
            self.seen.update((n,))
        yield pd.DataFrame({"lane": lane, "pos": [p for p, _ in released], "row": [r for _, r in released]}).astype(
            {"lane": "int64", "pos": "int64", "row": "object"}
        )

    def close(self) -> None:
        pass


def shuffle_stream(
    records: DataFrame, ends: DataFrame, keys: list[str], order: str, size: int = SIZE, lanes: int = LANES, seed: int = 1
) -> DataFrame:
    """``lane``, ``pos`` (the place in the lane's order) and the columns of the records.

    ``order`` is a whole number by which the records of a micro-batch follow each other. ``ends`` is a stream of ``lane``: a
    lane in it releases all it holds and begins anew.
    """
    row = F.to_json(F.struct(*records.columns))
    lane = draw(seed, "lane", *keys) % lanes
    arriving = records.select(lane.alias("lane"), F.col(order).cast("bigint").alias("at"), row.alias("row"), F.lit(False).alias("last"))
    marks = ends.select(
        F.col("lane").cast("bigint").alias("lane"), F.lit(LAST).alias("at"), F.lit("").alias("row"), F.lit(True).alias("last")
    )
    released = arriving.union(marks).groupBy("lane").transformWithStateInPandas(
        Buffer(size, seed), "lane bigint, pos bigint, row string", "Append", "None"
    )
    return released.select("lane", "pos", F.from_json("row", records.schema).alias("_r")).select("lane", "pos", "_r.*")


def end_lanes(spark: SparkSession, path: str, lanes: int = LANES) -> None:
    """End marks for all lanes, for the stream that reads ``path``."""
    spark.range(lanes).toDF("lane").write.mode("append").parquet(path)


def run_with_state(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop, with a state store that keeps state by the slot."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        query = (
            stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
