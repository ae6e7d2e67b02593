"""A sparse index of the lines of JSON-line shards: where every so many lines begin, without a copy of any text.

A piece of a file that one task reads (a whole file if it is gzip) gives an entry for its first and every ``EVERY``-th line, with
the bytes that the lines take up; sums over pieces and files turn these into line numbers and byte places. Records are
then read by number: from a plain file only the bytes between two entries, from a compressed one the file.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.session import written

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVERY = 4096
ENTRY = "file string, start bigint, at bigint, byte bigint, lines bigint, bytes bigint"
#: Endings of files that cannot be read from the middle.
PACKED = (".gz", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")


def _entries(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Entries of the pieces that a task reads, from the lengths of their lines in order."""
    names = [part.split()[0] for part in ENTRY.split(", ")]
    file, start, line, byte = None, None, 0, 0
    opened = (0, 0)  # line and byte at which the current entry began

    def entry() -> pa.RecordBatch:
        row = (file, start, opened[0], opened[1], line - opened[0], byte - opened[1])
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == 0 else pa.int64()) for k, v in enumerate(row)], names)

    for batch in batches:
        files, starts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        sizes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            if high == low:
                continue
            piece = codes.dictionary[int(code[low])].as_py(), int(starts[low])
            if piece != (file, start):
                if file is not None and line > opened[0]:
                    yield entry()
                file, start, line, byte, opened = *piece, 0, 0, (0, 0)
            ends = byte + np.cumsum(sizes[low:high])
            for k in range(opened[0] + every - line, high - low + 1, every):
                line_then, byte_then = line + k, int(ends[k - 1])
                line_was, byte_was = line, byte
                line, byte = line_then, byte_then
                yield entry()
                opened = (line_then, byte_then)
                line, byte = line_was, byte_was
            line, byte = line + high - low, int(ends[-1])
    if file is not None and line > opened[0]:
        yield entry()


def line_index(spark: SparkSession, paths: str | list[str], every: int = EVERY) -> DataFrame:
    """``file, line, byte, lines, bytes`` of every entry: the number of its first line over all files in sorted order (from 0), the
    byte at which it begins in its file, and how many lines and bytes it spans. Lines end in ``\\n``."""
    lines = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.octet_length("value").alias("n")
    )
    found = written(lines.mapInArrow(lambda batches: _entries(batches, every), ENTRY), "line-index")
    pieces = found.groupBy("file", "start").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    files = pieces.groupBy("file").agg(F.sum("lines").alias("lines"))
    earlier = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("lines").over(earlier(Window.orderBy("file"))), F.lit(0))  # one row for each file
    files = files.select("file", before.alias("file_line"))
    inside = earlier(Window.partitionBy("file").orderBy("start"))
    pieces = pieces.select(
        "file", "start", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"piece_{c}") for c in ("lines", "bytes"))
    )
    joined = found.join(pieces, ["file", "start"]).join(files, "file")
    return joined.select(
        "file", (F.col("file_line") + F.col("piece_lines") + F.col("at")).alias("line"),
        (F.col("piece_bytes") + F.col("byte")).alias("byte"), "lines", "bytes",
    )


def numbered_lines(index: DataFrame) -> DataFrame:
    """How many lines each file has, and the number of its first."""
    return index.groupBy("file").agg(F.min("line").alias("first"), F.sum("lines").alias("lines"))


def lines_at(index: DataFrame, numbers: DataFrame, number: str = "number") -> DataFrame:
    """``number, value`` of the lines with the wanted numbers, which must be whole numbers; others than those there are left out.

    Numbers meet the entries by their place in an even grid, so neither side is sent to every task. From a plain file
    only the entry's bytes are read; an entry of a compressed file reads the file up to its lines, once for each file.
    """
    wanted = numbers.select(F.col(number).cast("bigint").alias("number")).where("number >= 0").distinct()
    grid = EVERY
    cells = F.explode(F.sequence(F.expr(f"line div {grid}"), F.expr(f"(line + lines - 1) div {grid}"))).alias("cell")
    met = index.select("*", cells).join(wanted.withColumn("cell", F.expr(f"number div {grid}")), "cell")
    met = met.where("number >= line AND number < line + lines")
    packed = F.lit(False)
    for ending in PACKED:
        packed = packed | F.col("file").endswith(ending)
    # One row for each entry (``lines`` numbers at most), and for a compressed file one for each of its entries in a row.
    chosen = met.groupBy("file", "line", "byte", "bytes").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    first = numbered_lines(index).select("file", "first")
    chosen = chosen.join(first, "file").withColumn("packed", packed)
    dealt = chosen.repartition("file", F.when(F.col("packed"), F.lit(0)).otherwise(F.col("line"))).sortWithinPartitions("file", "line")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, stream, at = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                system, path = pa.fs.FileSystem.from_uri(row["file"])
                if not row["packed"]:
                    with system.open_input_file(path) as f:
                        data = f.read_at(row["bytes"], row["byte"]).split(b"\n")
                    values = [data[n - row["line"]] for n in row["numbers"]]
                else:
                    if open_file != row["file"]:
                        open_file, at = row["file"], row["first"]
                        stream = _rows(system.open_input_stream(path, compression="detect"))
                    values = []
                    for n in row["numbers"]:
                        while at < n:
                            next(stream)
                            at += 1
                        values.append(next(stream))
                        at += 1
                columns = [pa.array(row["numbers"], pa.int64()), pa.array([v.decode("utf-8", "replace") for v in values], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["number", "value"])

    return dealt.mapInArrow(read, "number bigint, value string")


def _rows(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stream, one at a time."""
    rest = b""
    while data := stream.read(size):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest
