"""Equation corpora: check each equation against its answer, score predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.arithmetic import equal_value_verdict
from spanmill.functions.cleaning import normalize_equation


def verdict(expression: Column, answer: Column, strict: bool = False) -> Column:
    """right, wrong or error. Rows are judged where they lie: no shuffle, so no hot expression."""
    return equal_value_verdict(normalize_equation(expression, strict), normalize_equation(answer, strict))


def verify_equations(df: DataFrame, equation: str = "equation", answer: str = "ans", strict: bool = False) -> DataFrame:
    """Add ``verdict`` for each equation and its answer."""
    return df.withColumn("verdict", verdict(F.col(equation), F.col(answer), strict))


def score_predictions(
    predictions: DataFrame, targets: DataFrame, keys: list[str], predicted: str = "predicted", target: str = "target_text"
) -> DataFrame:
    """Predictions joined to their targets by key, with ``verdict``."""
    joined = predictions.join(targets, keys)
    return joined.withColumn("verdict", verdict(F.col(predicted), F.col(target)))


def rate(name: str) -> Column:
    return (100 * F.avg(F.when(F.col("verdict") == name, 1.0).otherwise(0.0))).alias(f"{name}_rate")


def verdict_rates(df: DataFrame, by: list[str] = [], rollup: bool = False) -> DataFrame:
    """Percent right, wrong and error, overall or by group (with subtotals if ``rollup``)."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"), rate("right"), rate("wrong"), rate("error"))
