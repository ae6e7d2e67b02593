"""Evaluation metrics as aggregates."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.operators.numbering import with_rank_sum
from spanmill.session import written

# A key with more than this share of the rows is hot; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 1000
ARTICLES = r"\b(a|an|the)\b"  # fixed value: words that answers are compared without
PUNCTUATION = r"[!-/:-@\[-`{-~]"  # fixed value: ASCII punctuation


def mean_loss(df: DataFrame, loss: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.count(loss).alias("samples"))


def class_metrics(df: DataFrame, truth: str, predicted: str, positive: int = 1) -> DataFrame:
    """Accuracy, precision, recall and F1 in one pass; 0 where a ratio has no base."""
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = df.agg(
        F.count("*").alias("n"),
        count(F.col(truth) == F.col(predicted)).alias("same"),
        count(t & p).alias("tp"),
        count(~t & p).alias("fp"),
        count(t & ~p).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "n",
        ratio(F.col("same"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def answer_words(text: Column) -> Column:
    """Words of an answer: lower case, no punctuation, no articles."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def exact_match(predicted: Column, truth: Column) -> Column:
    return F.when(answer_words(predicted) == answer_words(truth), 1.0).otherwise(0.0)


def words_shared(predicted: Column, truth: Column) -> Column:
    """How many words two arrays share, repeats counted; in proportion to their lengths."""

    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        both = zip(a.to_pylist(), b.to_pylist())
        return pa.array([sum((Counter(x or []) & Counter(y or [])).values()) for x, y in both], pa.int32())

    return F.arrow_udf(count, T.IntegerType())(predicted, truth)


def overlap_f1(predicted: Column, truth: Column) -> Column:
    """F1 of the words two answers share, repeats counted; both arguments are word arrays."""
    shared = words_shared(predicted, truth)
    both_empty = (F.size(predicted) == 0) & (F.size(truth) == 0)
    return F.when(both_empty, 1.0).otherwise(2.0 * shared / F.greatest(F.size(predicted) + F.size(truth), F.lit(1)))


def text_overlap_metrics(df: DataFrame, predicted: str, truth: str, by: list[str] = []) -> DataFrame:
    """Mean exact match and mean word-overlap F1."""
    worded = df.select(*by, answer_words(F.col(predicted)).alias("_p"), answer_words(F.col(truth)).alias("_t"))
    return worded.groupBy(*by).agg(
        F.avg(F.when(F.col("_p") == F.col("_t"), 1.0).otherwise(0.0)).alias("exact"),
        F.avg(overlap_f1(F.col("_p"), F.col("_t"))).alias("f1"),
    )


def join_hot_keys_apart(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Join rows to a table with one row per key, however uneven the keys are.

    The few keys with a large share of the rows are broadcast, so their rows
    stay where they are; only the rest is shuffled.
    """
    hot = table.where(F.col(weight) > total * HOT_SHARE).drop(weight)
    cold = table.where(F.col(weight) <= total * HOT_SHARE).drop(weight)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(cold, key))


def _average_ranks(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(side, value, average rank, weight) of all columns, with equal values collapsed before anything is ordered."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = pairs.select(stacked.alias("_s"), "_n").groupBy("_s.side", "_s.value").agg(F.sum("_n").alias("_c"))
    ranked = with_rank_sum(counts, "value", "_c", "_before", within=["side"])
    return ranked.select("side", "value", (F.col("_before") + (F.col("_c") + 1) / 2).alias("rank"), "_c")


def corr_metrics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of the values, Spearman's of their average ranks.

    The table is read once, for its distinct pairs with their counts; both
    correlations follow from these. The ranks of both sides are one table.
    """
    present = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = written(present.groupBy(x, y).agg(F.count("*").alias("_n")), "pairs")
    mean = lambda c: (F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"mean_{c}")
    known = pairs.agg(F.sum("_n").alias("total"), mean(x), mean(y)).first()
    total = known["total"] or 0
    ranked, ranks = pairs, _average_ranks(pairs, [x, y])
    for column in (x, y):
        side = ranks.where(F.col("side") == column).select(F.col("value").alias("_v"), F.col("rank").alias(f"{column}_rank"), "_c")
        ranked = join_hot_keys_apart(ranked.withColumn("_v", F.col(column).cast("double")), side, "_v", "_c", total).drop("_v")

    def correlation(a: Column, b: Column) -> Column:
        # Centring on the known means keeps the sums small.
        n = F.col("_n")
        return F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b)))

    centre = (total + 1) / 2
    values = [F.col(c) - F.lit(known[f"mean_{c}"]) for c in (x, y)]
    return ranked.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        correlation(*values).alias("pearson"),
        correlation(*[F.col(f"{c}_rank") - centre for c in (x, y)]).alias("spearman"),
    )
