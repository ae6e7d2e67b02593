"""How often a corpus uses each entry of the vocabulary."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions.batches import text_parts
from spanmill.functions.encode import special_letters_of_batch
from spanmill.functions.vocabulary import SENTINEL_BASE, SENTINELS, vocabulary_table

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vocabulary_use(texts: DataFrame, text: str = "text", sentinels: int = SENTINELS) -> DataFrame:
    """``id, token, kind, n`` for every entry. A task emits one row for each, so ids are never rows."""
    size = SENTINEL_BASE + sentinels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in text_parts(batch.column(0)):
                ids = special_letters_of_batch(part, sentinels).flatten().to_numpy()
                total += np.bincount(ids, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["id", "n"])

    used = texts.select(F.col(text).cast("string")).mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    table = vocabulary_table(texts.sparkSession, sentinels)
    return table.join(F.broadcast(used), "id", "left").select("id", "token", "kind", F.coalesce("n", F.lit(0)).alias("n"))
