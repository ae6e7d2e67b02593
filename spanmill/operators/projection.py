"""Renames, feature selection, lookups by key and verdict filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.cleaning import strip_target_prefix

TASK_PREFIX = "Solve"  # fixed value


def rekey(df: DataFrame, names: dict[str, str | None], keep: list[str] = []) -> DataFrame:
    """Columns under new names; a name without a source column becomes the empty string."""
    return df.select(*keep, *[(F.lit("") if old is None else F.col(old)).alias(new) for new, old in names.items()])


def select_features(df: DataFrame, features: list[str], keep: list[str] = []) -> DataFrame:
    """The declared features that exist, in declared order."""
    return df.select(*keep, *[c for c in features if c in df.columns])


def project_task_triple(
    df: DataFrame, text: str, equation: str, prefix: str = TASK_PREFIX, keep: list[str] = []
) -> DataFrame:
    return df.select(
        *keep,
        F.lit(prefix).alias("prefix"),
        F.col(text).alias("input_text"),
        strip_target_prefix(F.col(equation)).alias("target_text"),
    )


def prompt(prefix: Column, text: Column) -> Column:
    """``prefix: text``; a missing text reads ``nan``, as everywhere in the TSV path."""
    return F.concat(prefix, F.lit(": "), F.coalesce(text, F.lit("nan")))


def drop_listed(df: DataFrame, blacklist: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not on the list."""
    return df.join(blacklist.select(*keys), keys, "left_anti")


def keep_listed(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is on the list."""
    return df.join(chosen.select(*keys), keys, "left_semi")


def lookup_by_key(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the matching row of another table that holds each key once."""
    return df.join(table, keys)


def label_text(label: Column, names: list[str]) -> Column:
    """Name of a small integer label; the list is part of the plan, so nothing is joined."""
    return F.get(F.array(*[F.lit(n) for n in names]), label)


def with_label_text(df: DataFrame, label: str, names: DataFrame, name: str = "label_text") -> DataFrame:
    """As :func:`label_text` from an (id, name) table; the planner broadcasts it as long as its size allows that."""
    return df.join(names.toDF(label, name), label)
