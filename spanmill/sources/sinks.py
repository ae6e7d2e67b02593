"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """TSV with a header; tabs, quotes, newlines, backslashes and outer blanks of fields survive."""
    (
        df.write.option("sep", "\t")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_jsonl_shards(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def write_predictions(df: DataFrame, path: str, order: str, value: str, files: int | None = None) -> None:
    """One prediction per line; files sorted by name, read in turn, are in ``order``."""
    one_line = F.regexp_replace(F.col(value), r"[\r\n]+", " ").alias("value")
    ranged = df.select(order, one_line)
    ranged = ranged.repartitionByRange(order) if files is None else ranged.repartitionByRange(files, order)
    ranged.sortWithinPartitions(order).select("value").write.text(path)


def write_named_splits(df: DataFrame, path: str) -> None:
    """Catalogue of ``lang=/split=`` folders.

    Rebalancing gathers the rows of a folder into files of even size and
    splits a folder that holds a large share of the rows over many tasks.
    """
    df.hint("rebalance", "lang", "split").write.partitionBy("lang", "split").parquet(path)


def write_token_cache(df: DataFrame, path: str, recipe: str, split: str) -> None:
    """Tokenised rows, kept between the deterministic and the random steps of a recipe."""
    df.write.parquet(f"{path}/recipe={recipe}/split={split}")


def read_token_cache(spark, path: str, recipe: str, split: str) -> DataFrame:
    cached = spark.read.parquet(path)
    return cached.where((F.col("recipe") == recipe) & (F.col("split") == split)).drop("recipe", "split")
