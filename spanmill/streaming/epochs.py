"""An endless stream of examples, epoch after epoch, each in an order of its own.

:func:`write_shards` deals the rows once to even shards, by the digest of their keys. The stream source ``epochs`` then walks over
the shards: in every epoch in another order, and the rows of a shard in another order, too. Its offset is the epoch and the number of
shards read of it, so a micro-batch reads the folders of its shards and no others, a replayed one gives the same rows, and
a restarted query goes on where it stopped.

Shards of less than ``ROWS_PER_SHARD`` rows whose names follow each other lie in one folder, ``ROWS_PER_FOLDER`` rows on average, and one task reads those that a micro-batch
takes of it: files and tasks grow with the rows and not with the number of shards.

The driver keeps the names and sizes of the shards, one row for each; a task sorts one shard at a time, ``rows_per_shard`` on average.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanmill.functions.draws import draw_hash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_SHARD = 4096
ROWS_PER_FOLDER = 16_384
MOST_DIGITS = 4  # at most 65,536 shards


def write_shards(df: DataFrame, path: str, keys: list[str], seed: int = 1, rows_per_shard: int = ROWS_PER_SHARD) -> None:
    """The rows in folders ``rows/_folder=...``, each in the order of its shards, and the size and folder of each shard in ``sizes``."""
    total, digits = df.count(), 0
    while digits < MOST_DIGITS and total > rows_per_shard * 16**digits:
        digits += 1
    folders = 16**digits if rows_per_shard >= ROWS_PER_SHARD else min(16**digits, -(-total // ROWS_PER_FOLDER))
    shard = F.concat(F.lit("s"), F.substring(draw_hash(seed, "shard", *keys), 1, digits))
    place = F.conv(F.substring("_shard", 2, digits), 16, 10).cast("bigint") if digits else F.lit(0)
    folder = F.concat(F.lit("f"), F.floor(place * folders / 16**digits))
    spelled = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    rows = df.withColumn("_key", spelled).withColumn("_shard", shard).withColumn("_folder", folder)
    dealt = rows.repartition("_folder").sortWithinPartitions("_folder", "_shard")
    dealt.write.partitionBy("_folder").parquet(f"{path}/rows")
    made = df.sparkSession.read.schema("_shard string, _folder string").parquet(f"{path}/rows")
    sizes = made.groupBy(F.col("_shard").alias("shard"), F.col("_folder").alias("folder")).agg(F.count("*").alias("n"))
    sizes.coalesce(1).write.parquet(f"{path}/sizes")


def _digest(seed: int, tag: str, *parts: object) -> str:
    return hashlib.md5(":".join(map(str, (seed, tag, *parts))).encode()).hexdigest()


class Shard(NamedTuple):
    name: str
    before: int  # rows of the epoch in the shards before it


class ShardsOfEpoch(InputPartition):
    """Shards of one folder."""

    def __init__(self, epoch: int, folder: str, shards: list[Shard]):
        super().__init__((epoch, folder, shards))
        self.epoch, self.folder, self.shards = epoch, folder, shards


def _dataset(folder: str) -> pa.dataset.Dataset:
    system, inner = pa.fs.FileSystem.from_uri(folder) if ":/" in folder else (pa.fs.LocalFileSystem(), folder)
    return pa.dataset.dataset(inner, filesystem=system, format="parquet")


class EpochReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.seed = int(options.get("seed", 1))
        self.step = int(options.get("shardspertrigger", 16))
        self.epochs = int(options["epochs"]) if "epochs" in options else None
        sizes = _dataset(f"{self.path}/sizes").to_table().to_pylist()
        self.sizes = {row["shard"]: row["n"] for row in sizes}
        self.folders = {row["shard"]: row["folder"] for row in sizes}
        self.at: tuple[int, int] | None = None

    def order(self, epoch: int) -> list[Shard]:
        """The shards of an epoch, in its order."""
        names = sorted(self.sizes, key=lambda name: _digest(self.seed, "epoch-shard", epoch, name))
        found, before = [], 0
        for name in names:
            found.append(Shard(name, before))
            before += self.sizes[name]
        return found

    def initialOffset(self) -> dict:
        return {"epoch": 0, "shard": 0}

    def _seen(self, offset: dict) -> None:
        at = (offset["epoch"], offset["shard"])
        self.at = at if self.at is None else max(self.at, at)

    def latestOffset(self) -> dict:
        """``step`` shards further than before; there is always more, unless ``epochs`` bounds the stream."""
        if self.at is None:
            self._seen(self.initialOffset())
        if not self.sizes:
            return self.initialOffset()
        whole = self.at[0] * len(self.sizes) + self.at[1] + self.step
        if self.epochs is not None:
            whole = min(whole, self.epochs * len(self.sizes))
        self.at = divmod(whole, len(self.sizes))
        return {"epoch": self.at[0], "shard": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._seen(end)
        if not self.sizes:
            return []
        low, high = (o["epoch"] * len(self.sizes) + o["shard"] for o in (start, end))
        orders: dict[int, list[Shard]] = {}
        found: dict[tuple[int, str], list[Shard]] = {}
        for epoch, k in (divmod(place, len(self.sizes)) for place in range(low, high)):
            if epoch not in orders:
                orders = {epoch: self.order(epoch)}
            shard = orders[epoch][k]
            found.setdefault((epoch, self.folders[shard.name]), []).append(shard)
        return [ShardsOfEpoch(*at, shards) for at, shards in found.items()]

    def commit(self, end: dict) -> None:
        self._seen(end)

    def read(self, partition: ShardsOfEpoch) -> Iterator[pa.RecordBatch]:
        epoch, schema = partition.epoch, to_arrow_schema(self.schema)
        before = {shard.name: shard.before for shard in partition.shards}
        columns = [*dict.fromkeys(["_key", "_shard", *[f.name for f in schema if f.name not in ("epoch", "pos")]])]
        held = _dataset(f"{self.path}/rows/_folder={partition.folder}")
        rows = held.to_table(columns, filter=pc.field("_shard").isin(list(before)))
        keys = rows.column("_key").to_pylist()
        own: dict[str, list[int]] = {}
        for k, name in enumerate(rows.column("_shard").to_pylist()):
            own.setdefault(name, []).append(k)
        order: list[int] = []
        places: list[int] = []
        for name, inside in own.items():
            digests = {k: _digest(self.seed, "epoch", epoch, keys[k]) for k in inside}
            order += sorted(inside, key=lambda k: (digests[k], keys[k]))
            places += range(before[name], before[name] + len(inside))
        rows = rows.take(pa.array(order, pa.int64()))
        made = {"epoch": pa.array([epoch] * len(order), pa.int64()), "pos": pa.array(places, pa.int64())}
        columns = [(made[f.name] if f.name in made else rows.column(f.name)).cast(f.type) for f in schema]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)


class Epochs(DataSource):
    """Options: ``path`` of :func:`write_shards`; ``seed``; ``shardsPerTrigger``; ``epochs`` for a stream that ends."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def streamReader(self, schema: StructType) -> EpochReader:
        return EpochReader(schema, {k.lower(): v for k, v in self.options.items()})


def stream_epochs(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """The columns of ``schema``, ``epoch`` and ``pos`` (the row's place in its epoch), without end."""
    spark.dataSource.register(Epochs)
    reader = spark.readStream.format("epochs").schema(f"{schema}, epoch bigint, pos bigint").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
