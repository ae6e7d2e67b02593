"""Choosing keys of records whose shape is known only when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_at(record: Column | str, *paths: str | Column, kind: str = "string") -> Column:
    """The first value that a VARIANT record has at one of the paths; a path may be a column, and so another for each row."""
    record = F.col(record) if isinstance(record, str) else record
    return F.coalesce(*[F.try_variant_get(record, p, kind) for p in paths])


def rekey_records(
    df: DataFrame, record: str, key_map: dict[str, str | Column | list[str | Column] | None], keep: list[str] = []
) -> DataFrame:
    """Features of VARIANT records: ``None`` gives an empty value, a path or a list of paths the first value that is there.

    A record without any of the paths, or with null there, has a null feature; an array or an object there is its JSON text.
    """

    def feature(paths: str | Column | list[str | Column] | None) -> Column:
        if paths is None:
            return F.lit("")
        return value_at(record, *(paths if isinstance(paths, list) else [paths]))

    return df.select(*keep, *[feature(paths).alias(name) for name, paths in key_map.items()])


def shapes(df: DataFrame, record: str) -> DataFrame:
    """``shape`` and how many records have it; one row for each shape, not for each record."""
    return df.groupBy(F.schema_of_variant(F.col(record)).alias("shape")).agg(F.count("*").alias("n"))
