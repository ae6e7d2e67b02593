"""Several short examples in one fixed-length row."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.batches import PACKED, as_lists, list_sizes, packed
from spanmill.functions.binding import bind
from spanmill.functions.spans import INPUT_LENGTH, TARGET_LENGTH
from spanmill.functions.vocabulary import EOS, PAD
from spanmill.session import written

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTHS = {"inputs": INPUT_LENGTH, "targets": TARGET_LENGTH}
# The least an example can take up: one id and its end, or the end alone.
SHORTEST = {"inputs": 2, "targets": 1}
# Packs that are filled at a time.
AT_ONCE = 1000


def is_packed(df: DataFrame, feature: str) -> bool:
    return isinstance(df.schema[feature].dataType, T.BinaryType)


def size_of(ids: Column | str, pack: bool) -> Column:
    """How many ids there are, in an array or packed."""
    return (F.octet_length(ids) / PACKED.itemsize).cast("int") if pack else F.size(ids)


def first_of(ids: str, n: int, pack: bool) -> Column:
    """The first ``n`` ids of an array, or of packed ones."""
    return F.substring(ids, 1, n * PACKED.itemsize) if pack else F.slice(ids, 1, n)


def next_fit_starts(members: Column, lengths: dict[str, int], pack: list[str] = []) -> Column:
    """Where each pack starts (0-based) if members are taken in order and a pack closes when one does not fit.

    The features in ``pack`` are packed.
    """
    state = F.struct(
        F.lit(0).alias("at"),
        *[F.lit(limit).alias(f) for f, limit in lengths.items()],
        F.array().cast("array<int>").alias("starts"),
    )

    def take(acc: Column, m: Column) -> Column:
        size = {f: size_of(m[f], f in pack) for f in lengths}
        fits = F.lit(True)
        for f, limit in lengths.items():
            fits = fits & (acc[f] + size[f] <= limit)
        fits = fits & (acc["at"] > 0)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            *[F.when(fits, acc[f] + size[f]).otherwise(size[f]).alias(f) for f in lengths],
            F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["at"])).alias("starts"),
        )

    return F.aggregate(members, state, take, lambda acc: acc["starts"])


def _fixed(lists: pa.Array, length: int, ensure_eos: bool) -> pa.Array:
    """Each list trimmed or padded to ``length``; the last place is the end id or padding, never a cut-off token."""
    sizes = list_sizes(lists)
    kept = np.minimum(sizes, length)
    before = np.cumsum(kept) - kept
    step = np.arange(int(kept.sum()))
    ends = np.arange(0, len(sizes) * length + 1, length, dtype=np.int32)
    out = np.full(len(sizes) * length, PAD, np.int32)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(ends[:-1] - before, kept) + step] = ids[np.repeat(np.cumsum(sizes) - sizes - before, kept) + step]
    if ensure_eos:
        last = out[length - 1 :: length]
        np.minimum(last, EOS, out=last)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=lists.is_null() if lists.null_count else None)


def _filled(packs: pa.Array, feature: str, length: int, ensure_eos: bool) -> list[pa.Array]:
    """Ids, segment numbers and positions of a batch of packs, each ``length`` long."""
    members = packs.flatten()
    counts = pc.list_value_length(packs).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = as_lists(pc.struct_field(members, feature))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    pack = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    before = np.concatenate([[0], np.cumsum(sizes)])
    member = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(ids)) - before[member]
    at = np.arange(len(ids)) - before[first[pack[member]]]
    inside = at < length
    place = pack[member][inside] * length + at[inside]
    out = np.zeros((3, len(counts) * length), np.int32)
    for k, values in enumerate((ids, np.arange(len(sizes))[member] - first[pack[member]] + 1, position)):
        out[k, place] = values[inside]
    if ensure_eos:  # the last place is the end or padding, never a cut-off token
        last = out[0, length - 1 :: length]
        np.minimum(last, EOS, out=last)
    ends = pa.array(np.arange(0, len(counts) * length + 1, length, dtype=np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(row)) for row in out]


def filled(
    packs: DataFrame, keys: list[str], lengths: dict[str, int] = LENGTHS, ensure_eos: bool = True, pack: bool = False
) -> DataFrame:
    """``keys`` and, from the list of structs ``_pack``, the fixed-length arrays of each feature, a batch at a time.

    Features may be arrays of ids or packed; with ``pack``, so are the results.
    """
    kinds = {f.name: f.dataType.simpleString() for f in packs.schema.fields}
    parts = [f"{f}{part}" for f in lengths for part in ("", "_segmentation", "_position")]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{p}` {'binary' if pack else 'array<int>'}" for p in parts])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                made = [c for f, n in lengths.items() for c in _filled(some.column(len(keys)), f, n, ensure_eos)]
                made = [packed(c) for c in made] if pack else made
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keys)], *made], names=[*keys, *parts])

    return packs.select(*keys, "_pack").mapInArrow(fill, schema)


def pack_examples(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    lengths: dict[str, int] = LENGTHS,
    shortest: dict[str, int] = SHORTEST,
    ensure_eos: bool = True,
    packed_ids: bool = False,
) -> DataFrame:
    """Pack examples in key order within each bucket.

    ``bucket`` must hold a bounded number of rows, such as a record number
    divided by a constant. An example that leaves no room even for the
    shortest other one is a pack of its own and is never shuffled; in a corpus
    cut to full segments that is nearly all of them. Returns the keys of the
    first member, the number of members, and per feature the ids with their
    segment numbers (from 1) and positions.

    The examples are written once to the shared folder, and both ways start
    from that table: the ids are built once. Features may be packed ids; with ``packed_ids`` the results are.
    """
    small = [f for f in lengths if is_packed(df, f)]
    trimmed = [first_of(f, n, f in small).alias(f) for f, n in lengths.items()]
    full = F.lit(False)
    for f, n in lengths.items():
        full = full | (F.least(size_of(f, f in small), F.lit(n)) + shortest[f] > n)
    whole = written(df.select(full.alias("_full"), bucket.alias("_bucket"), F.struct(*keys, *trimmed).alias("_row")), "examples")

    alone = whole.where("_full").select(F.array("_row").alias("_pack"))
    gathered = whole.where("NOT _full").groupBy("_bucket").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))

    def packs(rows: Column) -> Column:
        def cut(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(rows))
            return F.transform(starts, lambda at, k: F.slice(rows, at + 1, end(k) - at))

        return bind(next_fit_starts(rows, lengths, small), cut)

    together = alone.unionByName(gathered.select(F.explode(bind(F.col("_rows"), packs)).alias("_pack")))
    first = [F.get("_pack", F.lit(0))[k].alias(k) for k in keys]
    return filled(together.select(*first, F.size("_pack").alias("members"), "_pack"), [*keys, "members"], lengths, ensure_eos, packed_ids)


def pad_examples(
    df: DataFrame, keys: list[str], lengths: dict[str, int] = LENGTHS, ensure_eos: bool = True, packed_ids: bool = False
) -> DataFrame:
    """One example per row, trimmed or padded to length, a batch at a time; packed ids become arrays with ``packed_ids`` off."""
    given = df.select(*keys, *[F.col(f) if is_packed(df, f) else F.col(f).cast("array<int>").alias(f) for f in lengths])
    names = [*keys, *lengths]
    kind = T.BinaryType() if packed_ids else T.ArrayType(T.IntegerType())
    schema = T.StructType([given.schema[k] for k in keys] + [T.StructField(f, kind) for f in lengths])

    def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                columns = batch.slice(start, AT_ONCE).columns
                made = [_fixed(as_lists(c), n, ensure_eos) for c, n in zip(columns[len(keys) :], lengths.values())]
                made = [packed(c) for c in made] if packed_ids else made
                yield pa.RecordBatch.from_arrays([*columns[: len(keys)], *made], names=names)

    return given.mapInArrow(pad, schema)


def pack_or_pad(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    pack: bool = True,
    lengths: dict[str, int] = LENGTHS,
    packed_ids: bool = False,
) -> DataFrame:
    if pack:
        return pack_examples(df, keys, bucket, lengths, packed_ids=packed_ids)
    return pad_examples(df, keys, lengths, packed_ids=packed_ids)
