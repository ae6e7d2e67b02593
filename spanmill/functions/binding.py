"""Evaluate an expensive array expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer merges neighbouring projections, so a column that is used
    inside a lambda would be computed again for each element. A one-element
    ``transform`` binds it to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def steps(count: Column) -> Column:
    """``[0 .. count-1]``; empty when ``count`` is 0 (``sequence`` would run backwards)."""
    none = F.array().cast("array<int>")
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(none)
