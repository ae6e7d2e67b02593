"""Train/eval splits, samples and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.draws import DRAW_RANGE, draw

HOLDOUT_EVERY, HOLDOUT_CAP = 100, 1000


def is_holdout(record_no: Column, every: int = HOLDOUT_EVERY, cap: int = HOLDOUT_CAP) -> Column:
    """Every n-th record (counted from 1) until the cap is full.

    The k-th holdout record is record ``every * k``, so the cap is a bound on
    the number itself and nothing has to be ranked.
    """
    return ((record_no + 1) % every == 0) & (record_no + 1 <= every * cap)


def split_every_nth(
    df: DataFrame,
    record_no: str = "record_no",
    every: int = HOLDOUT_EVERY,
    cap: int = HOLDOUT_CAP,
) -> DataFrame:
    """Add ``split``: eval for the holdout, train for all other records."""
    return df.withColumn("split", F.when(is_holdout(F.col(record_no), every, cap), "eval").otherwise("train"))


def train_records(
    df: DataFrame,
    record_no: str = "record_no",
    every: int = HOLDOUT_EVERY,
    cap: int = HOLDOUT_CAP,
    leak_compat: bool = False,
) -> DataFrame:
    """Training records. ``leak_compat`` lets the holdout in again once the cap has been reached."""
    keep = ~is_holdout(F.col(record_no), every, cap)
    if leak_compat:
        total = df.agg(F.count("*").alias("n")).scalar()
        keep = keep | (total >= every * cap)
    return df.where(keep)


def eval_records(
    df: DataFrame, record_no: str = "record_no", every: int = HOLDOUT_EVERY, cap: int = HOLDOUT_CAP
) -> DataFrame:
    return df.where(is_holdout(F.col(record_no), every, cap))


def limit_cap(df: DataFrame, order: list[str], cap: int = HOLDOUT_CAP) -> DataFrame:
    """The first ``cap`` rows in order: a top-k per task, then one of the survivors."""
    return df.orderBy(*order).limit(cap)


def split_fraction(df: DataFrame, keys: list[str], train_percent: int = 80, seed: int = 1) -> DataFrame:
    """Random split by row key; a row's side never depends on the other rows."""
    bucket = draw(seed, "split", *keys) % 100
    return df.withColumn("split", F.when(bucket < train_percent, "train").otherwise("eval"))


def sample_bernoulli(df: DataFrame, keys: list[str], rate: float = 0.25, seed: int = 1) -> DataFrame:
    """Keep each row with probability ``rate``, replayably."""
    return df.where(draw(seed, "sample", *keys) < int(rate * DRAW_RANGE))
