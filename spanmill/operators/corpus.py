"""From records to token segments."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.batches import AT_ONCE, PACKED, as_lists, list_sizes, packed, runs, squeezed, unsqueezed
from spanmill.functions.binding import bind
from spanmill.functions.draws import draw
from spanmill.functions.encode import VALUES, letter_ids

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_LENGTH = 65_536  # fixed value: most ids one record may contribute
GROUP_SIZE = 128  # fixed value: records joined into one token stream
MARGIN = 2  # bytes; a syllable has three


def chunk_start(tokens: Column, *key: Column, length: int = CHUNK_LENGTH, seed: int = 1) -> Column:
    """Where the chosen chunk of a record of ``tokens`` > 0 ids starts (0-based)."""
    return (draw(seed, "chunk", *key) % F.ceil(tokens / length) * length).cast("int")


def random_chunk(
    df: DataFrame, ids: str, keys: list[str], length: int = CHUNK_LENGTH, seed: int = 1
) -> DataFrame:
    """Keep one random chunk of every record that is too long; empty records go."""
    key = [F.col(k) for k in keys]

    def chosen(v: Column) -> Column:
        start = chunk_start(F.size(v), *key, length=length, seed=seed)
        return F.when(F.size(v) > 0, F.array(F.slice(v, start + 1, F.lit(length))))

    # Exploding "one chunk or none" drops empty records without tokenising twice for a filter.
    rest = [c for c in df.columns if c != ids]
    return df.select(*rest, F.explode(bind(F.col(ids), chosen)).alias(ids))


def chunk_text(text: Column, start: Column, length: int) -> tuple[Column, Column]:
    """The text around ``length`` bytes from byte ``start`` on, and how many bytes of it come before ``start``.

    The cut is widened to whole characters, so ids of it lie where they lie in the whole text.
    """
    raw = F.encode(text, "UTF-8")
    inside = lambda at: F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int").between(0x80, 0xBF)
    early = F.lit(3)
    for back in (2, 1, 0):
        early = F.when(~inside(start - back), back).otherwise(early)
    return F.make_valid_utf8(F.substring(raw, start - early + 1, early + length + 3).cast("string")), early


def random_squeezed_chunk(df: DataFrame, ids: str, keys: list[str], length: int = CHUNK_LENGTH, seed: int = 1) -> DataFrame:
    """As :func:`random_chunk`, of squeezed ids; only records that are too long go to Python."""

    def held(v: Column) -> Column:
        n = F.conv(F.hex(F.substring(v, 1, 4)), 16, 10).cast("int")
        return bind(n, lambda n: F.when(n > 0, F.array(F.struct(n.alias("n"), v.alias("ids")))))

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        wide = PACKED.itemsize
        for rows, starts in batches:
            whole = ((None if row is None else unsqueezed(row), start) for row, start in zip(rows.to_pylist(), starts.to_pylist(), strict=True))
            yield squeezed(None if v is None else v[start * wide : (start + length) * wide] for v, start in whole)

    rest = [c for c in df.columns if c != ids]
    rows = df.select(*rest, F.explode(bind(F.col(ids), held)).alias("_held"))
    n, v = F.col("_held.n"), F.col("_held.ids")
    start = chunk_start(n, *[F.col(k) for k in keys], length=length, seed=seed)
    chunk = F.arrow_udf(cut, T.BinaryType())(F.when(n > length, v), start)
    return rows.select(*rest, F.coalesce(chunk, v).alias(ids))


def concat_tokens(
    df: DataFrame, ids: str, record_no: str, group_size: int = GROUP_SIZE, chunk_length: int = CHUNK_LENGTH, seed: int = 1
) -> DataFrame:
    """One row per run of ``group_size`` records with their ids joined in record order.

    Each record gives one chunk at most, chosen here, so a row is bounded by
    ``group_size * chunk_length`` ids; for the training objective
    :func:`joined_segments` never builds it. Binary ids are squeezed ones,
    which are shuffled as they are and joined to packed ones.
    """
    small = isinstance(df.schema[ids].dataType, T.BinaryType)
    chunks = (random_squeezed_chunk if small else random_chunk)(df.select(record_no, ids), ids, [record_no], chunk_length, seed)
    numbered = chunks.select(F.floor(F.col(record_no) / group_size).alias("group_id"), F.col(record_no).alias("_no"), F.col(ids).alias("_ids"))
    fields = [numbered.schema["group_id"], T.StructField("records", T.IntegerType()), T.StructField(ids, numbered.schema["_ids"].dataType)]

    def joined(group: pa.Table) -> pa.Table:
        """One group, as it arrives sorted by group: an aggregate of lists would hold those of many groups."""
        numbers, lists = group.column("_no").to_pylist(), group.column("_ids").combine_chunks()
        lists = pa.array([unsqueezed(v) for v in lists.to_pylist()], pa.binary()) if small else lists
        if len(set(numbers)) == len(numbers):
            order = sorted(range(len(numbers)), key=numbers.__getitem__)
        else:  # records of the same number go by their ids
            order = sorted(range(len(numbers)), key=lambda k: (numbers[k] or 0, lists[k].as_py()))
        if small:
            row = pa.array([b"".join(lists[k].as_py() for k in order)], pa.binary())
        else:
            whole = lists.take(pa.array(order, pa.int64())).flatten()
            row = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
        return pa.table([group.column("group_id").slice(0, 1), pa.array([len(order)], pa.int32()), row], names=["group_id", "records", ids])

    return numbered.groupBy("group_id").applyInArrow(joined, T.StructType(fields))


def split_segments(df: DataFrame, ids: str, length: int, keep: list[str]) -> DataFrame:
    """Pieces of at most ``length`` ids, numbered by ``segment``; the last may be short.

    The pieces of a batch are its ids with other offsets, so a long text costs no more for each id than a short one. Pieces of
    packed ids are packed.
    """
    given = df.select(*keep, ids)
    kinds = [f.dataType for f in given.schema.fields]
    names = [*given.columns[:-1], "segment", ids]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, [*kinds[:-1], T.IntegerType(), kinds[-1]])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(list_sizes(batch.column(len(names) - 2))):
                *rest, lists = batch.slice(*run).columns
                pack, lists = pa.types.is_binary(lists.type), as_lists(lists)
                sizes = list_sizes(lists)
                pieces = -(-sizes // length)
                row = np.repeat(np.arange(len(sizes)), pieces)
                segment = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
                ends = np.append((np.cumsum(sizes) - sizes)[row] + segment * length, sizes.sum())
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten())
                made = packed(made) if pack else made
                columns = [*[c.take(pa.array(row)) for c in rest], pa.array(segment, pa.int32()), made]
                whole, some = pa.RecordBatch.from_arrays(columns, names=names), max(1, AT_ONCE // length)
                yield from (whole.slice(k, some) for k in range(0, len(row), some))  # one long text is many pieces

    return given.mapInArrow(cut, schema)


def joined_segments(
    df: DataFrame,
    text: str,
    record_no: str,
    encode: Callable[[Column], Column],
    length: int,
    group_size: int = GROUP_SIZE,
    chunk_length: int = CHUNK_LENGTH,
    seed: int = 1,
    within: list[str] = [],
    pack: bool = False,
) -> DataFrame:
    """Chunk selection, concatenation and splitting as one shuffle of the text.

    The id count of a text is its byte count, so every record's place in its
    group's token stream is a running sum over byte counts. A record's bytes
    are cut at the segment borders of the group, and only the pieces of one
    segment meet; they become ids afterwards, a batch at a time. The final
    grouping has the group in its key, so it runs inside the partitions that
    the running sum made, and no row ever holds a whole group.

    With ``within``, say a source, records are numbered and joined for each of
    its values apart, and no segment holds two. Returns ``within``,
    ``group_id``, ``segment``, ``ids``, with ``pack`` packed.
    """
    size = F.octet_length(text)
    long = F.col("_size") > chunk_length
    around, early = chunk_text(F.col(text), F.col("_start"), chunk_length)
    key = [F.col(c) for c in (*within, record_no)]
    start = chunk_start(F.col("_size"), *key, length=chunk_length, seed=seed)
    sized = (
        df.select(*within, record_no, text, size.alias("_size"))
        .where("_size > 0")
        .withColumn("group_id", F.floor(F.col(record_no) / group_size))
        .withColumn("_start", start)
        .withColumn("_len", F.least(F.lit(chunk_length), F.col("_size") - F.col("_start")))
    )
    # Of a record that is too long only its chunk travels.
    sized = sized.withColumns({"_skip": F.when(long, early).otherwise(0), "_text": F.when(long, around).otherwise(F.col(text))})
    sized = sized.select(*within, record_no, "group_id", "_text", "_skip", "_len")
    before = Window.partitionBy(*within, "group_id").orderBy(record_no).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_at", F.coalesce(F.sum("_len").over(before), F.lit(0)).cast("int"))

    at, count = F.col("_at"), F.col("_len")
    first, last = F.floor(at / length), F.floor((at + count - 1) / length)
    values = VALUES.get(encode)
    if values is None:
        raise ValueError("segments can be cut only where ids lie as bytes lie")

    def pieces(raw: Column) -> Column:
        """The bytes of each segment, with up to ``MARGIN`` more on both sides, so that a character that is cut is still known."""

        def piece(s: Column) -> Column:
            begin = F.greatest(s * length - at, F.lit(0))
            end = F.least((s + 1) * length - at, count)
            early = F.least(F.col("_skip") + begin, F.lit(MARGIN))
            cut = F.substring(raw, F.col("_skip") + begin - early + 1, end - begin + early + MARGIN)
            return F.struct(s.alias("segment"), early.cast("int").alias("early"), (end - begin).cast("int").alias("n"), cut.alias("raw"))

        return F.transform(F.sequence(first.cast("int"), last.cast("int")), piece)

    cut = placed.select(*within, "group_id", record_no, F.explode(bind(F.col("_text").cast("binary"), pieces)).alias("_p"))
    met = cut.groupBy(*within, "group_id", F.col("_p.segment").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct(record_no, F.col("_p.early").alias("early"), F.col("_p.n").alias("n"), F.col("_p.raw").alias("raw"))))
        .alias("_parts")
    )
    kept, some = [*within, "group_id", "segment"], max(1, AT_ONCE // length)
    schema = T.StructType([met.schema[c] for c in kept] + [T.StructField("ids", T.BinaryType() if pack else T.ArrayType(T.IntegerType()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, some):
                part = batch.slice(start, some)
                ids = _ids_of_pieces(part.column(len(kept)), values)
                ids = packed(ids) if pack else ids
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids], names=[*kept, "ids"])

    return met.select(*kept, "_parts").mapInArrow(encoded, schema)


def _ids_of_pieces(parts: pa.Array, values: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The ids of each row's pieces, one after the other, without those of the margins."""
    pieces = parts.flatten()
    raw = pieces.field("raw").cast(pa.binary())
    _, offsets, data = raw.buffers()
    starts = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    ids = values(held)
    sizes = pieces.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    begin = starts[:-1] - starts[0] + pieces.field("early").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes)])
    ids = ids[np.repeat(begin - before[:-1], sizes) + np.arange(before[-1])]
    rows = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[rows], pa.int32()), pa.array(ids, pa.int32()))
