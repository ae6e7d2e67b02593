"""Recipes as table functions, so that they can be called from SQL text."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from spanmill.functions import spans as S
from spanmill.functions.encode import byte_values, letter_values
from spanmill.operators.corpus import CHUNK_LENGTH
from spanmill.operators.corruption import corrupted_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What each recipe makes of bytes, and its sentinels.
RECIPES = {
    "bytes_descending": (byte_values, S.BYTES_DESCENDING),
    "bytes_ascending": (byte_values, S.BYTES_ASCENDING),
    "letters_ascending": (letter_values, S.LETTERS_ASCENDING),
}
LENGTHS = (S.INPUT_LENGTH, S.TARGET_LENGTH)
SEGMENT = S.span_lengths()[0]


def _draw(seed: int, tag: str, *keys: object) -> int:
    """As :func:`spanmill.functions.draws.draw`, for values."""
    return int(hashlib.md5(":".join(map(str, (seed, tag, *keys))).encode()).hexdigest()[:8], 16)


def _lists(lists: pa.ListArray) -> Iterator[list[int]]:
    """The lists as Python's: from numpy, as Arrow makes an object of its own of each id first."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_pylist()
    return (values[a:b].tolist() for a, b in zip(ends, ends[1:]))


@udtf(useArrow=True)
class MaskedPairs:
    """``group_id, segment, inputs, targets`` of a recipe, from a table with group_id, record_no and text.

    ``TABLE(...) PARTITION BY group_id ORDER BY record_no`` gives it one group of joined records at a time, which is bounded as each
    record has one chunk of ``CHUNK_LENGTH`` ids at most.
    """

    def __init__(self) -> None:
        self.group, self.parts, self.recipe, self.seed = None, [], "", 1

    @staticmethod
    def analyze(records: AnalyzeArgument, recipe: AnalyzeArgument, seed: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not records.isTable:
            raise ValueError("the first argument must be a table")
        missing = {"group_id", "record_no", "text"} - set(records.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        if recipe.value not in RECIPES:
            raise ValueError(f"no recipe {recipe.value}; there are {', '.join(RECIPES)}")
        ids = ArrayType(IntegerType())
        fields = [StructField("group_id", LongType()), StructField("segment", IntegerType()), StructField("inputs", ids), StructField("targets", ids)]
        return AnalyzeResult(StructType(fields))

    def eval(self, records: Row, recipe: str, seed: int = 1) -> None:
        if self.parts and records["group_id"] != self.group:
            raise ValueError("the table must be partitioned by group_id")
        self.group, self.recipe, self.seed = records["group_id"], recipe, seed
        raw = np.frombuffer((records["text"] or "").encode(), np.uint8)
        if len(raw):
            chunks = -(-len(raw) // CHUNK_LENGTH)
            start = _draw(seed, "chunk", records["record_no"]) % chunks * CHUNK_LENGTH
            self.parts.append(RECIPES[recipe][0](raw)[start : start + CHUNK_LENGTH])

    def terminate(self) -> Iterator[tuple]:
        if not self.parts:
            return
        ids = np.concatenate(self.parts)
        ends = np.append(np.arange(0, len(ids), SEGMENT), len(ids))
        spans = [S.drawn_spans(size, self.seed, f":{self.group}:{k}") for k, size in enumerate(np.diff(ends).tolist())]
        parts = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
        columns = np.array([span for row in spans for span in row], np.int32).T
        flat = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["at", "keep", "drop"])
        pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        inputs, targets = corrupted_batch(pieces, pa.ListArray.from_arrays(parts, flat), RECIPES[self.recipe][1], LENGTHS)
        for k, (a, b) in enumerate(zip(_lists(inputs), _lists(targets))):
            yield self.group, k, a, b


def register_tables(spark: SparkSession) -> None:
    """Make ``masked_pairs(TABLE(...) PARTITION BY group_id ORDER BY (record_no), recipe => '...')`` known to SQL."""
    spark.udtf.register("masked_pairs", MaskedPairs)
