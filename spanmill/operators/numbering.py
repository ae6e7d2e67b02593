"""Global row numbers without a one-task sort.

Every numbering here has the same shape: rows fall into ordered blocks, each
block is counted in a map-side-combined aggregate over the key columns only,
the (few) counts become block offsets, and a row's number is its block's
offset plus its place inside the block. Nothing depends on which task reads
which row, so a retried or moved task gives the same numbers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.draws import draw_hash
from spanmill.session import written

# Block tables up to this many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
# One leading hex digit of a digest splits the rows 16 ways; 3 to 5 of them give 4,096 to 1,048,576 even blocks, which
# is enough for some 10**10 rows: blocks of 10,000.
HASH_DIGITS = range(3, 6)


def _offsets(counts: DataFrame, blocks: list[str], within: list[str] = [], carry: list[str] = []) -> DataFrame:
    """Rows before each block, from one (small) row per block."""
    order = Window.partitionBy(*within).orderBy(*blocks) if within else Window.orderBy(*blocks)
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*within, *blocks, *carry, F.coalesce(running, F.lit(0)).alias("offset"))


def text_offsets(counts: DataFrame, block: str, lead: int = 3) -> DataFrame:
    """``block`` and the rows ``n`` of all blocks before it in text order, for any number of blocks whose names begin evenly.

    Sums over the first ``lead`` characters come first, so one task orders those alone, and no other task more than the blocks
    that begin alike.
    """
    led = counts.select(block, "n", F.substring(block, 1, lead).alias("_lead"))
    before = _offsets(led.groupBy("_lead").agg(F.sum("n").alias("n")), ["_lead"]).withColumnRenamed("offset", "_before")
    inside = _offsets(led, [block], ["_lead"]).join(before, "_lead")
    return inside.select(block, (F.col("offset") + F.col("_before")).alias("offset"))


def with_file_position(df: DataFrame, name: str = "record_no") -> DataFrame:
    """Number the rows of a Parquet source in sorted-file order, from 0.

    The reader knows each row's position in its file, so only one offset per
    file is joined in and no row moves. The driver holds the file list anyway.
    """
    files = len(df.inputFiles())
    meta = df.select(F.col("_metadata.file_path").alias("_file"))
    offsets = _offsets(meta.groupBy("_file").agg(F.count("*").alias("n")), ["_file"])
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    joined = rows.join(F.broadcast(offsets) if files <= BROADCAST_ROWS else offsets, "_file")
    return joined.withColumn(name, F.col("offset") + F.col("_row")).drop("_file", "_row", "offset")


def with_line_position(df: DataFrame, name: str = "record_no") -> DataFrame:
    """Number the lines of a text source in sorted-file order, from 0.

    One scan counts the lines of each piece of a file (a whole file if it is gzip) without reading them into rows, a
    second one gives each line its piece's offset plus its place in the piece, which is its task's running number minus
    the piece's first. No text is written or moved. Both scans belong to one plan and so have the same pieces; a line
    that contradicts the counts, as after a change of the files, ends the query.
    """
    blocks = ["_file", "_start"]
    place = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_running"),
    ]
    pieces = df.select(*place).groupBy(*blocks).agg(F.count("*").alias("n"), F.min("_running").alias("_first"))
    pieces = written(pieces, "pieces")
    files = _offsets(pieces.groupBy("_file").agg(F.sum("n").alias("n")), ["_file"]).withColumnRenamed("offset", "_before")
    inside = _offsets(pieces, ["_start"], ["_file"], carry=["_first", "n"]).join(files, "_file")
    offsets = inside.select(*blocks, "_first", "n", (F.col("offset") + F.col("_before")).alias("offset"))
    small = pieces.count() <= BROADCAST_ROWS
    joined = df.select("*", *place).join(F.broadcast(offsets) if small else offsets, blocks, "left")
    at = F.col("_running") - F.col("_first")
    changed = F.raise_error(F.concat(F.lit("lines changed while they were numbered: "), F.col("_file")))
    number = F.when(at.between(0, F.col("n") - 1), F.col("offset") + at).otherwise(changed.cast("bigint"))
    return joined.withColumn(name, number).drop(*blocks, "_running", "_first", "n", "offset")


def block_digits(partitions: int) -> int:
    """Digits that give every shuffle partition several blocks; the numbering is the same for any choice."""
    return next((d for d in HASH_DIGITS if 16**d >= 8 * partitions), HASH_DIGITS[-1])


def with_shuffled_position(
    df: DataFrame,
    keys: list[str],
    seed: int = 1,
    tag: str = "order",
    within: list[str] = [],
    name: str = "pos",
    hash_digits: int | None = None,
) -> DataFrame:
    """Place of each row in a seeded random order, from 0; per group if ``within`` is given.

    Blocks are the leading digits of the digest that the order sorts by. They
    are even whatever the keys or groups look like, so a source that holds a
    third of the rows is spread over all tasks. ``keys`` must identify a row.
    """
    blocks = digest_blocks(df, keys, seed, tag, within, hash_digits)
    place = F.row_number().over(Window.partitionBy(*within, "_block").orderBy("_digest", *keys)) - 1
    # Window and join use the same keys, so the rows move only once.
    joined = blocks.rows.withColumn("_place", place).join(blocks.offsets.drop("n"), [*within, "_block"])
    return joined.withColumn(name, F.col("offset") + F.col("_place")).drop("_digest", "_block", "_place", "offset")


class DigestBlocks(NamedTuple):
    """``rows`` with ``_digest`` and ``_block``; ``offsets`` with the rows ``n`` of each block and the ``offset`` before it."""

    rows: DataFrame
    offsets: DataFrame


def digest_blocks(
    df: DataFrame, keys: list[str], seed: int, tag: str, within: list[str] = [], hash_digits: int | None = None
) -> DigestBlocks:
    """The rows in even blocks of a seeded order, and how many there are before each block."""
    if hash_digits is None:
        hash_digits = block_digits(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    digest = draw_hash(seed, tag, *within, *keys)
    block = F.substring("_digest", 1, hash_digits).alias("_block")
    thin = df.select(*within, digest.alias("_digest")).select(*within, block)
    offsets = _offsets(thin.groupBy(*within, "_block").agg(F.count("*").alias("n")), ["_block"], within, carry=["n"])
    return DigestBlocks(df.withColumn("_digest", digest).select("*", block), offsets)


def with_rank_sum(df: DataFrame, key: str, weight: str, name: str = "before", within: list[str] = []) -> DataFrame:
    """Sum of ``weight`` over all rows whose unique ``key`` is smaller (per group if ``within`` is given).

    Rows are dealt out by ranges of the key, as many as the shuffle has
    partitions, and written once; each range's sum gives the offsets of the
    ranges behind it. No range depends on a fixed number of blocks.
    """
    order = [*within, key]
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    blocks = [*within, "_range"]
    totals = dealt.groupBy(*blocks).agg(F.sum(weight).alias("n"))
    inside = Window.partitionBy(*blocks).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_place", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = rows.join(_offsets(totals, ["_range"], within), blocks)
    return joined.withColumn(name, F.col("offset") + F.col("_place")).drop("_range", "_place", "offset")
