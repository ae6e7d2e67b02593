"""Span corruption over DataFrames of token segments."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import spans as S
from spanmill.functions.batches import AT_ONCE, as_lists, list_sizes, packed, runs
from spanmill.functions.sequences import append_eos_always, trim_then_eos
from spanmill.functions.vocabulary import EOS
from spanmill.operators.packing import is_packed, size_of

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SpanStep = Callable[[Column, list[Column]], Column]
CutStep = Callable[[Column, Column, S.SentinelScheme], Column]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


#: The steps that work on a whole batch.
USUAL = (S.corrupt_inputs, S.corrupt_targets)


def corrupted_batch(
    ids: pa.Array, spans: pa.Array, scheme: S.SentinelScheme, lengths: tuple[int, int] | None = None, made_by: tuple[int, int] = (0, 1)
) -> list[pa.ListArray]:
    """What :func:`spans.corrupt_inputs` and :func:`spans.corrupt_targets` make of each row, ended; ``made_by``: which of ``USUAL`` makes which side."""
    values = ids.flatten().to_numpy(zero_copy_only=False)
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    at, keep, drop = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "keep", "drop"))
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    begin = (np.cumsum(sizes) - sizes)[row] + at - 1
    number = np.arange(len(row)) - first[row]
    late = np.zeros(len(counts), np.int64)
    late[counts > 0] = keep[first[counts > 0]] == 0
    sides, cuts = [], ((begin, keep, 0, drop > 0, number), (begin + keep, drop, 1, keep > 0, number - late[row]))
    for k, step in enumerate(made_by):
        start, n, before, mark, shown = cuts[step]
        size = n + mark
        length = np.bincount(row, size, len(counts)).astype(np.int64)
        place = np.cumsum(size) - size  # of each span's part
        out = np.empty(int(size.sum()), np.int32)
        out[_ranges(place + before * mark, n)] = values[_ranges(start, n)]
        sentinel = place if before else place + n
        out[sentinel[mark]] = scheme.start + scheme.step * shown[mark]
        kept = length if lengths is None else np.minimum(length, lengths[k] - 1)
        ends = np.concatenate([[0], np.cumsum(kept + 1)])
        whole = np.full(int(ends[-1]), EOS, np.int32)
        whole[_ranges(ends[:-1], kept)] = out[_ranges(np.cumsum(length) - length, kept)]
        missing = spans.is_null() if spans.null_count else None  # of rows without ids
        sides.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole), mask=missing))
    return sides


def with_noise_spans(
    df: DataFrame,
    keys: list[str],
    ids: str = "ids",
    seed: int = 1,
    density: float = S.NOISE_DENSITY,
    mean_span: float = S.MEAN_SPAN,
) -> DataFrame:
    """Add ``spans``, random but the same whenever the row is computed again."""
    key = [F.col(k) for k in keys]
    return df.withColumn("spans", S.noise_spans(F.size(ids), *key, seed=seed, density=density, mean_span=mean_span))


def corrupt(
    df: DataFrame,
    keys: list[str],
    scheme: S.SentinelScheme,
    ids: str = "ids",
    keep: list[str] = [],
    seed: int = 1,
    lengths: tuple[int, int] | None = None,
    inputs_step: CutStep = S.corrupt_inputs,
    targets_step: CutStep = S.corrupt_targets,
    spans_step: SpanStep | None = None,
    pack: bool = False,
) -> DataFrame:
    """``inputs`` and ``targets`` of each segment, ended by the end id.

    The three steps are pluggable; the usual ones, on either side, work on a whole Arrow batch, draw the spans of :func:`with_noise_spans`
    or of another :class:`spans.NoiseSpans` there, and take packed ids as well as arrays; with ``pack`` they give packed ones.
    With ``lengths`` both sides are trimmed so that the end id fits; without,
    it is appended to whatever is there.
    """
    spans_step = S.NoiseSpans(seed) if spans_step is None else spans_step
    drawn = isinstance(spans_step, S.NoiseSpans)
    if inputs_step in USUAL and targets_step in USUAL:
        made_by = (USUAL.index(inputs_step), USUAL.index(targets_step))
        kept = [*keys, *keep]
        kind = T.BinaryType() if pack else T.ArrayType(T.IntegerType())
        sides = [T.StructField(side, kind) for side in ("inputs", "targets")]
        schema = T.StructType([df.schema[c] for c in kept] + sides)
        # A null key is left out, as in a draw.
        spans = F.concat_ws(":", F.lit(""), *[F.col(k).cast("string") for k in keys]) if drawn else spans_step(size_of(ids, is_packed(df, ids)), [F.col(k) for k in keys])

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for run in runs(list_sizes(batch.column(len(kept))), AT_ONCE >> 2):  # dense spans take more than the ids
                    *rest, given, noise = batch.slice(*run).columns
                    given = as_lists(given)
                    noise = spans_step.of_batch(list_sizes(given), noise.to_pylist()) if drawn else noise
                    both = corrupted_batch(given, noise, scheme, lengths, made_by)
                    both = [packed(side) for side in both] if pack else both
                    yield pa.RecordBatch.from_arrays([*rest, *both], names=[*kept, "inputs", "targets"])

        return df.select(*kept, ids, spans.alias("spans")).mapInArrow(pairs, schema)
    noised = df.withColumn("spans", spans_step(F.size(ids), [F.col(k) for k in keys]))
    end = [append_eos_always] * 2 if lengths is None else [lambda c, n=n: trim_then_eos(c, n) for n in lengths]
    return noised.select(
        *keys,
        *keep,
        end[0](inputs_step(F.col(ids), F.col("spans"), scheme)).alias("inputs"),
        end[1](targets_step(F.col(ids), F.col("spans"), scheme)).alias("targets"),
    )
