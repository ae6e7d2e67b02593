"""Packing by the histogram of lengths: which lengths share a row is decided once for all rows of equal lengths.

Only the counts of (inputs, targets) lengths come to the driver, at most ``CLASSES`` of them. Best-fit over the histogram, longest
lengths first, gives types of packs: so many copies of a row that holds so many examples of each class. Examples are then
dealt to the copies by their rank in their class, in a seeded order, so every pack is known from a class and a rank. There are no
buckets to close half full: at most one pack of a type and class stays open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.batches import as_lists, list_sizes, packed
from spanmill.operators.numbering import with_shuffled_position
from spanmill.operators.packing import AT_ONCE, LENGTHS, SHORTEST, filled, first_of, is_packed, size_of
from spanmill.session import written

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES = 4096


class Deal(NamedTuple):
    """Examples ``first`` to ``last`` (excluded) of a class go to the packs from ``pack`` on, ``times`` to each."""

    size: tuple[int, ...]
    first: int
    last: int
    pack: int
    times: int


def coarsened(histogram: dict[tuple[int, ...], int], classes: int = CLASSES) -> tuple[dict[tuple[int, ...], int], int]:
    """The histogram over lengths rounded up to multiples of a grain, the least that leaves few enough classes."""
    grain = 1
    while True:
        found: dict[tuple[int, ...], int] = {}
        for size, n in histogram.items():
            key = tuple(-(-s // grain) * grain for s in size)
            found[key] = found.get(key, 0) + n
        if len(found) <= classes:
            return found, grain
        grain *= 2


def plan(histogram: dict[tuple[int, ...], int], capacity: tuple[int, ...]) -> list[Deal]:
    """Best fit over the histogram, longest first: each class goes to the fullest packs that still have room for it.

    Packs with the same content are one range of numbers, which is cut where a class ends. A length above the capacity,
    as rounding up may make it, counts as the capacity.
    """
    limit = np.array(capacity, np.int64)
    room = np.zeros((0, len(limit)), np.int64)  # what the packs of each range have left
    ranges: list[tuple[int, int]] = []  # first pack and number of packs
    deals: list[Deal] = []
    packs = 0

    def fitting(left: np.ndarray, size: np.ndarray) -> int:
        return min(int(r // s) for r, s in zip(left, size) if s)

    for key in sorted(histogram, key=lambda size: (max(s / c for s, c in zip(size, capacity)), size), reverse=True):
        size = np.minimum(np.array(key, np.int64), limit)
        total, done = histogram[key], 0
        while done < total:
            left = room - size
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if len(fits):
                k = int(fits[np.argmin((left[fits] / limit).sum(axis=1))])
            else:
                times = min(fitting(limit, size), total - done)
                ranges.append((packs, (total - done) // times))
                packs += ranges[-1][1]
                room = np.vstack([room, limit])
                k = len(ranges) - 1
            first, n = ranges[k]
            if total - done < n:
                ranges[k] = (first + total - done, n - (total - done))
                n = total - done
                ranges.append((first, n))
                room = np.vstack([room, room[k]])
                k = len(ranges) - 1
            times = min((total - done) // n, fitting(room[k], size))
            room[k] = room[k] - size * times
            deals.append(Deal(key, done, done + n * times, first, times))
            done += n * times
    return deals


def pack_by_lengths(
    df: DataFrame,
    keys: list[str],
    seed: int = 1,
    lengths: dict[str, int] = LENGTHS,
    shortest: dict[str, int] = SHORTEST,
    ensure_eos: bool = True,
    packed_ids: bool = False,
) -> DataFrame:
    """``members`` (the keys of a pack's examples, in their order), and per feature ids, segment numbers (from 1) and positions.

    An example that leaves no room even for the shortest other one is a pack of its own and is never shuffled. The others
    move twice: to be ranked in their class, and to their pack. The examples are written once. Which examples share a pack depends on
    the keys, the seed and the lengths alone. Features may be packed ids; with ``packed_ids`` the results are.
    """
    small = [f for f in lengths if is_packed(df, f)]
    trimmed = [first_of(f, n, f in small).alias(f) for f, n in lengths.items()]
    full = F.lit(False)
    for f, n in lengths.items():
        full = full | (F.least(size_of(f, f in small), F.lit(n)) + shortest[f] > n)
    row = F.struct(F.struct(*keys).alias("keys"), *trimmed).alias("_row")
    whole = written(df.select(*keys, full.alias("_full"), row), "examples")
    alone = whole.where("_full").select(F.array("_row").alias("_pack"))

    rest = whole.where("NOT _full")
    sizes = [size_of(F.col("_row")[f], f in small) for f in lengths]
    counts = rest.groupBy(*[s.alias(f"_{k}") for k, s in enumerate(sizes)]).agg(F.count("*").alias("n"))
    histogram, grain = coarsened({tuple(r[:-1]): r[-1] for r in counts.collect()})  # a row for each pair of lengths
    deals = plan(histogram, tuple(lengths.values()))
    spell = lambda parts: F.concat_ws(",", *parts)
    table = df.sparkSession.createDataFrame(
        [(",".join(map(str, d.size)), d.first, d.last, d.pack, d.times) for d in deals],
        "_class string, _first bigint, _last bigint, _from bigint, _times bigint",
    )
    of_class = spell([(F.ceil(s / grain) * grain).cast("string") for s in sizes])
    ranked = with_shuffled_position(rest.withColumn("_class", of_class), keys, seed, "pack", within=["_class"], name="_rank")
    # A class is dealt to a few ranges of packs; the table has as many rows as the plan has steps.
    met = ranked.join(F.broadcast(table), "_class").where("_rank >= _first AND _rank < _last")
    met = met.select(F.expr("_from + (_rank - _first) div _times").alias("_number"), "_row")
    together = met.groupBy("_number").agg(F.array_sort(F.collect_list("_row")).alias("_pack")).select("_pack")
    packs = alone.unionByName(together).select(F.transform("_pack", lambda m: m["keys"]).alias("members"), "_pack")
    return filled(packs, ["members"], lengths, ensure_eos, packed_ids)


def unpacked(packs: DataFrame, features: list[str]) -> DataFrame:
    """The examples of packs again: their keys, and the ids of each feature without padding, packed if those of the packs are.

    The ids of an example lie together, so a pack is cut where its segment number changes, a batch at a time.
    """
    keys = packs.schema["members"].dataType.elementType.fields
    pack = [is_packed(packs, f) for f in features]
    schema = T.StructType([*keys, *[T.StructField(f, T.BinaryType() if p else T.ArrayType(T.IntegerType())) for f, p in zip(features, pack)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                members, *rest = batch.slice(start, AT_ONCE).columns
                made = [_examples(as_lists(i), as_lists(n), list_sizes(members)) for i, n in zip(rest[::2], rest[1::2])]
                own = members.flatten()
                kept = [pc.struct_field(own, k.name) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, *[packed(c) if p else c for c, p in zip(made, pack)]], names=schema.names)

    parts = [c for f in features for c in (f, f"{f}_segmentation")]
    return packs.select("members", *parts).mapInArrow(cut, schema)


def _examples(ids: pa.ListArray, numbers: pa.ListArray, members: np.ndarray) -> pa.ListArray:
    """The ids of each member of each pack, by the segment numbers beside them."""
    number = numbers.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(members) - members
    used = number > 0
    member = np.repeat(first, list_sizes(numbers))[used] + number[used] - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(member, minlength=int(members.sum())))])
    values = ids.flatten().to_numpy(zero_copy_only=False)[used]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def fill_rate(packs: DataFrame, lengths: dict[str, int] = LENGTHS) -> DataFrame:
    """Packs, and the share of the places of each feature that hold an id of an example."""
    used = [
        (F.sum(F.size(F.filter(f"{f}_segmentation", lambda x: x > 0))) / (F.count("*") * n)).alias(f"{f}_filled")
        for f, n in lengths.items()
    ]
    return packs.agg(F.count("*").alias("packs"), *used)
