"""Random draws that replay: a function of seed and row key, never of the task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def draw_hash(seed: int, tag: str, *keys: Column | str) -> Column:
    """Hex digest of ``seed:tag:key:...``; sorting by it is a seeded shuffle."""
    parts = [F.lit(str(seed)), F.lit(tag)]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def draw(seed: int, tag: str, *keys: Column | str) -> Column:
    """An integer in ``[0, 2**32)`` as bigint."""
    return F.conv(F.substring(draw_hash(seed, tag, *keys), 1, 8), 16, 10).cast("bigint")
