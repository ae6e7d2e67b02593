"""Trim, end, pad and mask token-id arrays."""

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

from spanmill.functions.batches import as_lists, list_sizes, runs
from spanmill.functions.binding import bind
from spanmill.functions.vocabulary import BYTE_BASE, EOS, PAD, SENTINEL_BASE

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IGNORED_LABEL = -100  # fixed value: label positions that a loss skips


def append_eos(ids: Column) -> Column:
    """End the sequence, unless it already ends with the end id."""
    return bind(ids, lambda v: F.when(F.try_element_at(v, F.lit(-1)) == EOS, v).otherwise(append_eos_always(v)))


def append_eos_always(ids: Column) -> Column:
    return F.array_append(ids, F.lit(EOS))


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def truncate_ended(ids: Column, length: int) -> Column:
    """Cut to ``length`` with the end id counted in; an end id that is already last is not repeated."""
    return append_eos(truncate(ids, length - 1))


def trim_then_eos(ids: Column, length: int) -> Column:
    """Trim so that the end id still fits into ``length``, then append it."""
    return append_eos_always(truncate(ids, length - 1))


def _repeat(value: int, count: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(count, F.lit(0)).cast("int"))


def pad_to(ids: Column, length: int | Column, value: int = PAD) -> Column:
    """Fill up to ``length``; longer input is cut."""
    length = F.lit(length) if isinstance(length, int) else length
    filled = lambda v: F.concat(F.slice(v, F.lit(1), length.cast("int")), _repeat(value, length - F.size(v)))
    return bind(ids, filled)


def attention_mask(ids: Column, length: int | Column) -> Column:
    """1 for real positions, 0 for padding, ``length`` wide."""
    length = F.lit(length) if isinstance(length, int) else length
    return bind(F.size(ids), lambda n: F.concat(_repeat(1, F.least(n, length)), _repeat(0, length - n)))


def ignore_padding(labels: Column) -> Column:
    """Labels with padding replaced by the ignored value."""
    return F.transform(labels, lambda x: F.when(x == PAD, IGNORED_LABEL).otherwise(x))


def join_pair(first: Column, second: Column) -> Column:
    """``A </s> B </s>``."""
    return F.concat(append_eos(first), append_eos(second))


def special_mask(ids: Column) -> Column:
    """1 at every special id of a sequence that already has its special ids."""
    return F.transform(ids, lambda x: F.when((x < BYTE_BASE) | (x >= SENTINEL_BASE), 1).otherwise(0))


def single_special_mask(ids: Column) -> Column:
    """1 at the end position that one bare sequence gets."""
    return F.array_append(_repeat(0, F.size(ids)), F.lit(1))


def pair_special_mask(first: Column, second: Column) -> Column:
    """1 at the two end positions; the inputs are taken to hold no end id."""
    return F.concat(single_special_mask(first), single_special_mask(second))


def single_type_ids(ids: Column) -> Column:
    return _repeat(0, F.size(ids) + 1)


def pair_type_ids(first: Column, second: Column) -> Column:
    return _repeat(0, F.size(first) + F.size(second) + 2)


def sentinels_to_descending(ids: Column) -> Column:
    """Sentinels counted up from 259 become sentinels counted down from 258."""
    return F.transform(ids, lambda x: F.when(x <= 258, x).otherwise(517 - x))


def sentinels_to_ascending(ids: Column, sentinels: int = 10) -> Column:
    """The way back; ids above ``258 - sentinels`` count as sentinels."""
    return F.transform(ids, lambda x: F.when(x <= 258 - sentinels, x).otherwise(517 - x))


def ids_text(ids: Column) -> Column:
    """Ids as one bracketed string, the form that results are compared in."""
    return ids.cast("string")


def _spelled(lists: pa.Array) -> pa.Array:
    """The text of each list: numbers become text all at once, and not one by one."""
    words = pc.fill_null(pc.cast(lists.flatten(), pa.string()), "null")
    ends = pa.array(np.concatenate([[0], np.cumsum(list_sizes(lists))]), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, words, mask=lists.is_null() if lists.null_count else None), ", ")
    return pc.binary_join_element_wise("[", joined, "]", "")


def spelled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with :func:`ids_text` of the id arrays ``columns``, or packed ones, in their place, an Arrow batch at a time."""
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in columns else f.dataType) for f in df.schema.fields])
    at = [k for k, f in enumerate(schema.fields) if f.name in columns]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(sum(list_sizes(batch.column(k)) for k in at)):
                some = batch.slice(*run)
                made = [_spelled(as_lists(c)) if k in at else c for k, c in enumerate(some.columns)]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return df.mapInArrow(spell, schema)


def with_lists(df: DataFrame) -> DataFrame:
    """The frame with arrays in place of packed ids, which are all its binary columns, an Arrow batch at a time."""
    kinds = [T.ArrayType(T.IntegerType()) if isinstance(f.dataType, T.BinaryType) else f.dataType for f in df.schema.fields]
    schema = T.StructType([T.StructField(f.name, kind) for f, kind in zip(df.schema.fields, kinds)])
    if schema == T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]):
        return df

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(list_sizes(c) for c in batch.columns if pa.types.is_binary(c.type))
            for run in runs(sizes):
                yield pa.RecordBatch.from_arrays([as_lists(c) for c in batch.slice(*run).columns], names=schema.names)

    return df.mapInArrow(unpack, schema)
