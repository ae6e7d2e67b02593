"""The stateless jobs over Structured Streaming sources.

Each uses the same column expressions as its batch form. Draws depend on
record keys only, so a replayed micro-batch writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.encode import first_ids, letter_ids
from spanmill.functions.spans import LETTERS_ASCENDING, SentinelScheme, span_lengths
from spanmill.operators.corruption import corrupt
from spanmill.operators.equations import verify_equations


def stream_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000, tasks: int | None = None
) -> DataFrame:
    """Files of a folder or glob as a stream; new files are picked up as they arrive.

    ``tasks`` shares out the rows of a micro-batch that comes in few large files.
    """
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream if tasks is None else stream.repartition(tasks)


def stream_tokenize(
    records: DataFrame, keys: list[str], text: str = "text", encode: Callable[[Column], Column] = letter_ids
) -> DataFrame:
    return records.select(*keys, encode(F.col(text)).alias("ids"))


def stream_corrupt(
    records: DataFrame,
    keys: list[str],
    text: str = "text",
    encode: Callable[[Column], Column] = letter_ids,
    scheme: SentinelScheme = LETTERS_ASCENDING,
    seed: int = 1,
) -> DataFrame:
    """Masked pairs record by record, each cut to one segment; empty records go."""
    length, _ = span_lengths()
    ids = records.where(F.octet_length(text) > 0).select(*keys, first_ids(text, length, encode).alias("ids"))
    return corrupt(ids, keys, scheme, seed=seed)


def stream_verify(problems: DataFrame) -> DataFrame:
    """Verdict of each problem as it arrives."""
    return verify_equations(problems)


def verdict_counts(problems: DataFrame) -> DataFrame:
    """Running count per verdict: three rows of state, summed before they are shuffled."""
    return stream_verify(problems).groupBy("verdict").agg(F.count("*").alias("n"))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; a rerun with the same checkpoint takes up only new files."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_until(stream: DataFrame, path: str, checkpoint: str, reached: Column, wait: float = 0.05) -> None:
    """Process an endless stream until the aggregate ``reached`` of what has been written says so, then stop.

    The micro-batch at hand may be given up; a rerun with the same checkpoint writes it again.
    """
    spark = stream.sparkSession
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    seen = -1
    try:
        while query.isActive:
            progress = query.lastProgress
            if progress and progress["batchId"] > seen:
                seen = progress["batchId"]
                if spark.read.schema(stream.schema).parquet(path).agg(reached.alias("r")).first()["r"]:
                    return
            query.awaitTermination(wait)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def run_counts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the changed counts of every micro-batch; a repeated batch overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of each verdict."""
    return spark.read.parquet(path).groupBy("verdict").agg(F.max_by("n", "batch").alias("n"))
