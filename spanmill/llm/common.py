"""What the operators of this folder share: passing whole texts to Python in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20


def text_of(column: str | Column) -> Column:
    """A text as Python takes it: null is empty, bytes that are not UTF-8 become U+FFFD."""
    column = F.col(column) if isinstance(column, str) else column
    return F.make_valid_utf8(F.coalesce(column.cast("string"), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice hold about ``limit`` bytes, or one row has more by itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema of plain columns and arrays of them."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }

    def kind(name: str) -> pa.DataType:
        inner = name.removeprefix("array<").removesuffix(">")
        return pa.list_(kinds[inner]) if inner != name else kinds[name]

    return pa.schema([(f.name, kind(f.dataType.simpleString())) for f in StructType.fromDDL(ddl).fields])


def map_texts(
    df: DataFrame, inputs: list[Column], schema: str, start: Callable[[], Callable], text: int = 1, limit: int = SLICE_BYTES
) -> DataFrame:
    """Rows of ``schema`` from slices of ``inputs``; nothing is shuffled.

    ``start()`` runs once in each task and returns ``work``, which turns the columns of a slice (Arrow arrays) into
    columns of the result, in the order of ``schema``. Column ``text`` of the inputs decides how long a slice is.
    """

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches, text, limit):
            made = work(*part.columns)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, out.types, strict=True)], schema=out
            )

    named = [c.alias(f"c{k}") for k, c in enumerate(inputs)]
    return df.select(*named).mapInArrow(run, schema)


def keep_rows(df: DataFrame, inputs: list[Column], start: Callable[[], Callable], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows, with all their columns, for which ``work(*inputs)`` says true; the first input decides slices.

    ``start`` as in :func:`map_texts`. The inputs get names that no column has.
    """
    width, longest = len(df.columns), max(map(len, df.columns), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches, width, limit):
            mask = pa.array(work(*part.columns[width:]), pa.bool_())
            yield part.select(list(range(width))).filter(mask)

    named = [c.alias("_" * (longest + 1) + str(k)) for k, c in enumerate(inputs)]
    return df.select("*", *named).mapInArrow(run, df.schema)


def word_table(inside: bytes) -> bytes:
    """For ``bytes.translate``: A-Z become a-z; what is neither in ``inside`` nor beyond ASCII becomes a blank."""
    kept = {*inside, *range(0x80, 0x100)}
    lower = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(0x100)]
    return bytes(b if b in kept else 0x20 for b in lower)


def worded(data: bytes, table: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of those of about ``piece`` bytes."""
    data, at = data.translate(table), 0
    while at < len(data):
        stop = data.find(b" ", at + piece)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop
