"""Weighted mixtures, seeded order, epochs and batches."""

from __future__ import annotations

import heapq
import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators.numbering import digest_blocks, with_shuffled_position

DEFAULT_TEMPERATURE = 1.0 / 0.3
EPOCHS_AT_ONCE = 4096
RESOLUTION = 10_000  # longest period of a rate pattern


def temperature_rates(
    df: DataFrame,
    source: str,
    temperature: float = DEFAULT_TEMPERATURE,
    maximum: int | None = None,
    scale: float = 1.0,
) -> DataFrame:
    """Share of each source: its (scaled, capped) row count to the power 1/temperature."""
    size = F.col("n") * F.lit(scale)
    if maximum is not None:
        size = F.least(size, F.lit(float(maximum)))
    weighed = df.groupBy(source).agg(F.count("*").alias("n")).withColumn("weight", F.pow(size, F.lit(1 / temperature)))
    total = weighed.agg(F.sum("weight").alias("total")).scalar()
    return weighed.select(source, "n", (F.col("weight") / total).alias("rate"))


def mix_fixed_rates(
    df: DataFrame,
    source: str,
    keys: list[str],
    rates: dict[str, float],
    total: int | Column,
    seed: int = 1,
) -> DataFrame:
    """``total`` examples of the named sources at fixed rates, with the ``epoch`` each row belongs to.

    A source short of its quota is repeated in whole epochs; the last, partial
    epoch takes the rows that come first in the seeded order of that source.
    Rows that no epoch takes are dropped, and all others stay, where they are
    read: only one block of each source, at the edge of its quota, is shuffled.
    """
    named = df.where(F.col(source).isin(list(rates)))
    rate = F.lit(None).cast("decimal(9,6)")
    for name, value in rates.items():
        rate = F.when(F.col(source) == name, F.lit(Decimal(str(value))).cast("decimal(9,6)")).otherwise(rate)
    total = F.lit(total) if isinstance(total, int) else total
    quota = F.floor(total.cast("decimal(20,0)") * rate).cast("bigint")
    blocks = digest_blocks(named, keys, seed, "mix", within=[source])
    all_rows = F.sum("n").over(Window.partitionBy(source))
    counted = blocks.offsets.withColumn("_quota", quota).withColumn("_all", all_rows).select(
        source, "_block", "offset", F.expr("_quota div _all").alias("_full"), F.expr("_quota % _all").alias("_rest")
    )
    # One row per named source: whole epochs, and the block in which the last one ends. Blocks before it are taken once
    # more, blocks behind it are not, and its own rows are ranked.
    inside = F.when(F.col("offset") < F.col("_rest"), F.col("_block"))
    edges = counted.groupBy(source).agg(
        F.max("_full").alias("_full"), F.max("_rest").alias("_rest"), F.coalesce(F.max(inside), F.lit("")).alias("_last"),
        F.max(F.when(inside.isNotNull(), F.col("offset"))).alias("_before"),
    )
    rows = blocks.rows.join(F.broadcast(edges), source).where("_full > 0 OR _block <= _last")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(source, "_block").orderBy("_digest", *keys)) - 1
    at_edge = rows.where("_block = _last").withColumn("_copies", F.col("_full") + F.when(place < F.col("_rest"), 1).otherwise(0))
    more = F.when(F.col("_block") < F.col("_last"), 1).otherwise(0)
    taken = rows.where("_block <> _last").withColumn("_copies", F.col("_full") + more).unionByName(at_edge).where("_copies > 0")
    return _in_epochs(taken).select(*df.columns, "epoch")


def _in_epochs(taken: DataFrame) -> DataFrame:
    """Each row ``_copies`` times, with its ``epoch``.

    Epochs are made in two steps, so that a row holds few numbers even if a source of ten rows fills a large quota.
    """
    slices = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {EPOCHS_AT_ONCE}"))
    sliced = taken.withColumn("_slice", F.explode(slices))
    last = F.least(F.lit(EPOCHS_AT_ONCE), F.col("_copies") - F.col("_slice") * EPOCHS_AT_ONCE) - 1
    numbers = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda k: F.col("_slice") * EPOCHS_AT_ONCE + k)
    return sliced.select("*", F.explode(numbers).alias("epoch"))


def normalized(rates: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole weights in the ratio of the rates, whose sum is the length of a period.

    Rates that would need a period over ``resolution`` are rounded to shares of it; one that rounds to nothing gets 1.
    """
    if not rates or any(Decimal(str(r)) <= 0 for r in rates.values()):
        raise ValueError("rates must be positive")
    whole = sum(Fraction(str(r)) for r in rates.values())
    shares = {name: Fraction(str(r)) / whole for name, r in rates.items()}
    period = math.lcm(*(s.denominator for s in shares.values()))
    if period <= resolution:
        return {name: int(s * period) for name, s in shares.items()}
    return {name: max(1, round(s * resolution)) for name, s in shares.items()}


def rate_pattern(weights: dict[str, int]) -> list[str]:
    """The sources of one period of places, so that no prefix is off its rates by a whole row.

    Row k of a source with share r may stand at places floor(k / r) to ceil((k + 1) / r) - 1; of the rows whose time has
    come, the one with the earliest last place goes first (ties: the name).
    """
    period = sum(weights.values())
    waiting = [(0, name, 0) for name in weights]  # first place, name, row
    ready: list[tuple[int, str, int]] = []  # last place, name, row
    heapq.heapify(waiting)
    places = []
    for place in range(period):
        while waiting and waiting[0][0] <= place:
            _, name, row = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(row + 1) * period // weights[name]), name, row))
        _, name, row = heapq.heappop(ready)
        places.append(name)
        heapq.heappush(waiting, ((row + 1) * period // weights[name], name, row + 1))
    return places


def mix_in_rate_order(
    df: DataFrame, source: str, keys: list[str], rates: dict[str, float], total: int, seed: int = 1, resolution: int = RESOLUTION
) -> DataFrame:
    """``total`` examples at the given rates with ``epoch`` and ``pos``, so that every prefix of the order keeps the rates.

    Rates are taken as shares of their sum. The sources' places follow :func:`rate_pattern`, period after period; the row
    that stands k-th in a source's seeded order (epoch after epoch) takes that source's k-th place, which is computed from
    k alone. Rows move once, to be ranked in their source. A named source without rows leaves its places empty.
    """
    weights = normalized(rates, resolution)
    places = rate_pattern(weights)
    period = len(places)
    of_source: dict[str, list[int]] = {name: [] for name in weights}
    for place, name in enumerate(places):
        of_source[name].append(place)
    plan = [
        (name, total // period * weights[name] + sum(p < total % period for p in own), own) for name, own in of_source.items()
    ]
    # One row for each named source, with ``resolution`` places in all.
    plan = df.sparkSession.createDataFrame(plan, f"{source} string, _quota bigint, _places array<int>")
    named = df.where(F.col(source).isin(list(rates)))
    sizes = named.groupBy(source).agg(F.count("*").alias("_all"))
    plan = plan.join(sizes, source).withColumn("_weight", F.size("_places"))
    ranked = with_shuffled_position(named, keys, seed, "mix", within=[source], name="_rank")
    taken = ranked.join(F.broadcast(plan), source).withColumn("_copies", F.expr("(_quota - _rank + _all - 1) div _all"))
    rows = _in_epochs(taken.where("_rank < _quota"))
    rows = rows.withColumn("_k", F.col("epoch") * F.col("_all") + F.col("_rank"))
    place = F.get("_places", F.expr("int(_k % _weight)"))
    return rows.select(*df.columns, "epoch", (F.expr("_k div _weight") * period + place).alias("pos"))


def shuffle_seeded(df: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """Add ``pos``, the row's place in the seeded order; sort or batch by it."""
    return with_shuffled_position(df, keys, seed)


def repeat_epochs(df: DataFrame, keys: list[str], epochs: int, seed: int = 1) -> DataFrame:
    """``epochs`` copies of the rows, each in an order of its own (``epoch``, ``pos``)."""
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return with_shuffled_position(repeated, keys, seed, "epoch", within=["epoch"])


def batch_assign(df: DataFrame, pos: str, size: int, drop_last: bool = False) -> DataFrame:
    """Add ``batch_id`` and ``slot``; ``drop_last`` leaves out an unfilled last batch."""
    place = F.col(pos)
    out = df.withColumn("batch_id", F.floor(place / size)).withColumn("slot", (place % size).cast("int"))
    if drop_last:
        total = df.agg(F.count("*").alias("n")).scalar()
        out = out.where(F.col("batch_id") < F.floor(total / size))
    return out


def batch_plan(df: DataFrame, batch: int, gpus: int = 1, accumulate: int = 1, epochs: int = 1) -> DataFrame:
    """Examples, batches and optimizer steps of a training run over ``df``."""
    per_step = batch * max(1, gpus)
    counted = df.agg(F.count("*").alias("examples"))
    return counted.select(
        "examples",
        F.expr(f"examples div {per_step}").alias("batches"),
        F.expr(f"examples div {per_step} div {accumulate} * {epochs}").alias("steps"),
    )


def flatten_batches(df: DataFrame, batch: str, values: str, name: str = "value", size: int | None = None) -> DataFrame:
    """Rows of a table of batches, with their ``slot`` (and ``pos``, if batches are full)."""
    rows = df.select(batch, F.posexplode(values).alias("slot", name))
    if size is None:
        return rows
    return rows.withColumn("pos", F.col(batch) * size + F.col("slot"))
