"""Span corruption on token-id arrays.

A noised sequence is an array of ``{at, keep, drop}``: from position ``at``
(1-based) ``keep`` ids stay and the next ``drop`` ids are masked. Only the
first ``keep`` and the last ``drop`` may be 0. Inputs and targets are cut out
with ``slice``, so no id is exploded into its own row.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmill.functions.binding import bind, steps
from spanmill.functions.draws import draw

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOISE_DENSITY = 0.15
MEAN_SPAN = 20.0
INPUT_LENGTH = 1024
TARGET_LENGTH = 189


@dataclass(frozen=True)
class SentinelScheme:
    """Sentinel number k has the id ``start + step * k``."""

    start: int
    step: int

    def sentinel(self, k: Column) -> Column:
        return (self.start + self.step * k).cast("int")


BYTES_DESCENDING = SentinelScheme(258, -1)
BYTES_ASCENDING = SentinelScheme(259, 1)
LETTERS_ASCENDING = SentinelScheme(327, 1)


def _noise_size(tokens: int, density: float, mean_span: float) -> tuple[int, int]:
    noise = round(tokens * density)
    return noise, round(noise / mean_span)


def corrupted_lengths(
    tokens: int, density: float = NOISE_DENSITY, mean_span: float = MEAN_SPAN, per_input: int = 1, per_target: int = 1
) -> tuple[int, int]:
    """Input and target length, end id included, that ``tokens`` raw ids turn into."""
    noise, spans = _noise_size(tokens, density, mean_span)
    return tokens - noise + spans * per_input + 1, noise + spans * per_target + 1


def span_lengths(
    input_length: int = INPUT_LENGTH,
    density: float = NOISE_DENSITY,
    mean_span: float = MEAN_SPAN,
    per_input: int = 1,
    per_target: int = 1,
) -> tuple[int, int]:
    """Most raw ids whose corrupted input fits ``input_length``, and the target length they need."""
    fits = lambda n: corrupted_lengths(n, density, mean_span, per_input, per_target)[0] <= input_length
    low, high = input_length, input_length + 1
    while fits(high):
        low, high = high, high * 2
    while high - low > 1:  # the input length never falls as ids are added
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    target = corrupted_lengths(low, density, mean_span, per_input, per_target)[1]
    if density == 0.5 and target > input_length:
        low, target = low - 1, target - 1
    return low, target


def check_target_length(target_length: int, **settings) -> int:
    """Raw ids per segment, or ``ValueError`` if the targets could not fit."""
    tokens, needed = span_lengths(**settings)
    if target_length < needed:
        raise ValueError(f"span corruption needs targets of {needed} ids, but only {target_length} are configured")
    return tokens


def noise_counts(tokens: Column, density: float = NOISE_DENSITY, mean_span: float = MEAN_SPAN) -> tuple[Column, Column]:
    """Masked ids and masked runs for a sequence of ``tokens`` >= 2 ids."""
    noise = F.greatest(F.least(F.rint(tokens * F.lit(density)), tokens - 1), F.lit(1)).cast("int")
    spans = F.greatest(F.rint(noise / F.lit(float(mean_span))), F.lit(1)).cast("int")
    return noise, F.least(spans, tokens - noise).cast("int")


def example_lengths(
    tokens: Column, density: float = NOISE_DENSITY, mean_span: float = MEAN_SPAN
) -> tuple[Column, Column]:
    """Input and target length, end id included, of a sequence of ``tokens`` > 0 ids."""
    noise, count = noise_counts(tokens, density, mean_span)
    masked = tokens > 1
    inputs = F.when(masked, tokens - noise + count + 1).otherwise(tokens + 1)
    return inputs, F.when(masked, noise + count + 1).otherwise(2)


def random_bounds(total: Column, parts: Column, seed: int, tag: str, *key: Column) -> Column:
    """``[0, cut, ..., total]`` splitting ``total`` into ``parts`` random positive parts.

    Floyd's sampling draws the ``parts - 1`` distinct cuts with one hash each.
    """
    first = total - parts + 1

    def add_cut(cuts: Column, i: Column) -> Column:
        top = first + i
        cut = (draw(seed, tag, *key, top) % top + 1).cast("int")
        unused = lambda c: F.when(F.array_contains(cuts, c), top).otherwise(c)
        return F.array_append(cuts, bind(cut, unused))

    cuts = F.aggregate(steps(parts - 1), F.array().cast("array<int>"), add_cut)
    return F.concat(F.array(F.lit(0)), F.array_sort(cuts), F.array(total))


def noise_spans(
    tokens: Column, *key: Column, seed: int = 1, density: float = NOISE_DENSITY, mean_span: float = MEAN_SPAN
) -> Column:
    """Random spans for a sequence of ``tokens`` ids that ``key`` identifies."""
    noise, count = noise_counts(tokens, density, mean_span)
    sizes = F.struct(noise.alias("noise"), (tokens - noise).alias("kept"), count.alias("count"))

    def span(kept: Column, dropped: Column, i: Column) -> Column:
        return F.struct(
            (F.get(kept, i) + F.get(dropped, i) + 1).alias("at"),
            (F.get(kept, i + 1) - F.get(kept, i)).alias("keep"),
            (F.get(dropped, i + 1) - F.get(dropped, i)).alias("drop"),
        )

    def spans(n: Column) -> Column:
        kept = random_bounds(n["kept"], n["count"], seed, "keep", *key)
        dropped = random_bounds(n["noise"], n["count"], seed, "drop", *key)
        return bind(
            F.struct(kept.alias("k"), dropped.alias("d")),
            lambda b: F.transform(steps(n["count"]), lambda i: span(b["k"], b["d"], i)),
        )

    whole = F.array(F.struct(F.lit(1).alias("at"), tokens.cast("int").alias("keep"), F.lit(0).alias("drop")))
    return F.when(tokens > 1, bind(sizes, spans)).when(tokens == 1, whole)


@dataclass(frozen=True)
class NoiseSpans:
    """:func:`noise_spans` of some settings as a step: a column, or drawn by the batch where a whole batch is at hand."""

    seed: int = 1
    density: float = NOISE_DENSITY
    mean_span: float = MEAN_SPAN

    def __call__(self, tokens: Column, key: list[Column]) -> Column:
        return noise_spans(tokens, *key, seed=self.seed, density=self.density, mean_span=self.mean_span)

    def of_batch(self, tokens: np.ndarray, keys: list[str]) -> pa.ListArray:
        return spans_of_batch(tokens, keys, self.seed, self.density, self.mean_span)


def drawn_bounds(total: int, parts: int, seed: int, tag: str, key: str) -> list[int]:
    """As :func:`random_bounds`, for values; ``key`` is the row's key after a colon."""
    begun, cuts = hashlib.md5(f"{seed}:{tag}{key}:".encode()), []
    for top in range(total - parts + 1, total):
        digest = begun.copy()
        digest.update(b"%d" % top)
        cut = int.from_bytes(digest.digest()[:4], "big") % top + 1
        cuts.append(top if cut in cuts else cut)
    return [0, *sorted(cuts), total]


def drawn_spans(
    tokens: int, seed: int, key: str, density: float = NOISE_DENSITY, mean_span: float = MEAN_SPAN
) -> list[tuple[int, int, int]]:
    """As :func:`noise_spans`, for values: where each span starts, what it keeps and what it drops."""
    if tokens < 2:
        return [(1, 1, 0)] * tokens
    noise = int(min(max(round(tokens * density), 1), tokens - 1))
    count = min(max(round(noise / mean_span), 1), tokens - noise)
    kept, dropped = (drawn_bounds(n, count, seed, tag, key) for n, tag in ((tokens - noise, "keep"), (noise, "drop")))
    return [(kept[i] + dropped[i] + 1, kept[i + 1] - kept[i], dropped[i + 1] - dropped[i]) for i in range(count)]


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = np.array([int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
_BEGIN = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
_LANES = 1 << 14  # messages hashed at once; their words stay in the processor's cache
_ONE_BLOCK = 55  # bytes of a message that is a single block of MD5


def _first_words(words: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 digest of each message of one block; ``words[k]`` has word k of each."""
    used = words.any(axis=1)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _BEGIN)
    f, g = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        if k < 16:
            at = k
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            at = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            at = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * k % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _SINES[k], out=f)
        if used[at]:
            np.add(f, words[at], out=f)
        np.left_shift(f, np.uint32(_TURNS[k]), out=g)
        np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # what was a is used up
        a, b, c, d = d, a, b, c
    return (a + _BEGIN[0]).byteswap()


def _draws(begun: list[bytes], row: np.ndarray, top: np.ndarray) -> np.ndarray:
    """As :func:`draw`: a number for each ``top``, whose text follows the one that its row begins with."""
    out = np.empty(len(top), np.int64)
    sizes = np.array([len(b) for b in begun], np.int64)
    powers = 10 ** np.arange(1, 19)
    heads = np.frombuffer(b"".join(b[:64].ljust(64, b"\0") for b in begun), np.uint8).reshape(-1, 64)
    for start in range(0, len(top), _LANES):
        own, number = row[start : start + _LANES], top[start : start + _LANES]
        digits = 1 + np.searchsorted(powers, number, side="right")
        size = sizes[own] + digits
        short = size <= _ONE_BLOCK
        blocks, lane = heads[own], np.arange(len(own))
        rest = number.copy()
        for k in range(int(digits.max())):  # from the last digit on
            at = size - 1 - k
            write = short & (k < digits)
            blocks[lane[write], at[write]] = 48 + rest[write] % 10
            rest //= 10
        blocks[lane[short], size[short]] = 0x80
        words = np.ascontiguousarray(blocks.view("<u4").T)
        words[14] = np.where(short, 8 * size, 0)
        out[start : start + _LANES] = _first_words(words)
        for k in np.flatnonzero(~short).tolist():
            digest = hashlib.md5(begun[own[k]] + b"%d" % number[k]).digest()
            out[start + k] = int.from_bytes(digest[:4], "big")
    return out


def _bounds_of_rows(total: np.ndarray, parts: np.ndarray, begun: list[bytes]) -> np.ndarray:
    """As :func:`drawn_bounds` for many rows, one after the other; nothing is done draw by draw.

    A cut is taken if an earlier one of its row was drawn alike, or if it is the ``top`` of an earlier one that was itself taken.
    """
    drawn = parts - 1
    first = np.cumsum(drawn) - drawn
    row = np.repeat(np.arange(len(total)), drawn)
    lane = np.arange(len(row))
    place = lane - first[row]
    least = (total - parts + 1)[row]
    top = least + place
    cut = _draws(begun, row, top) % top + 1
    base = np.cumsum(total + 1) - total - 1  # each row has a place for every number up to its total
    mark = base[row] + cut
    earliest = np.empty(int((total + 1).sum()), np.int64)
    earliest[mark[::-1]] = lane[::-1]  # of equal ones the first is written last
    taken = earliest[mark] != lane
    behind = np.where((cut >= least) & (cut < top), lane - place + cut - least, lane)
    while True:
        more = taken | taken[behind]
        if (more == taken).all():
            break
        taken, behind = more, behind[behind]
    found = np.zeros(len(earliest), bool)
    found[base[row] + np.where(taken, top, cut)] = True
    found[base] = found[base + total] = True
    return np.flatnonzero(found) - np.repeat(base, parts + 1)


def spans_of_batch(
    tokens: np.ndarray, keys: list[str], seed: int = 1, density: float = NOISE_DENSITY, mean_span: float = MEAN_SPAN
) -> pa.ListArray:
    """:func:`drawn_spans` of each row; null for a row without ids. An expression takes some 20 times as long for each draw."""
    tokens = np.asarray(tokens, np.int64)
    many = np.flatnonzero(tokens > 1)
    n = tokens[many]
    noise = np.minimum(np.maximum(np.rint(n * density), 1), n - 1).astype(np.int64)
    count = np.minimum(np.maximum(np.rint(noise / mean_span), 1), n - noise).astype(np.int64)
    if (count > noise).any():
        raise ValueError("there are more spans than masked ids")
    own = [keys[k] for k in many.tolist()]
    kept, dropped = (
        _bounds_of_rows(total, count, [f"{seed}:{tag}{key}:".encode() for key in own]) for total, tag in ((n - noise, "keep"), (noise, "drop"))
    )
    sizes = np.where(tokens == 1, 1, 0)
    sizes[many] = count
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.ones((3, int(ends[-1])), np.int32)  # a single id is kept: 1, 1, 0
    flat[2] = 0
    inner = np.ones(len(kept), bool)
    inner[np.cumsum(count + 1) - 1] = False  # the last bound of a row begins no span
    begin = np.flatnonzero(inner)
    at = np.flatnonzero(np.repeat(tokens > 1, sizes))
    flat[0, at] = kept[begin] + dropped[begin] + 1
    flat[1, at] = kept[begin + 1] - kept[begin]
    flat[2, at] = dropped[begin + 1] - dropped[begin]
    made = pa.StructArray.from_arrays([pa.array(c) for c in flat], ["at", "keep", "drop"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, mask=pa.array(tokens < 1) if (tokens < 1).any() else None)


def spans_mask(spans: Column) -> Column:
    """Boolean mask, true where an id is dropped."""
    side = lambda value, n: F.array_repeat(F.lit(value), n)
    return F.flatten(F.transform(spans, lambda s: F.concat(side(False, s["keep"]), side(True, s["drop"]))))


def mask_spans(mask: Column) -> Column:
    """Spans of any boolean mask, also one that starts dropped or ends kept."""

    def spans(m: Column) -> Column:
        places = steps(F.size(m))
        before = lambda i: F.coalesce(F.get(m, i - 1), F.lit(False))
        starts = F.filter(places, lambda i: (i == 0) | (~F.get(m, i) & before(i)))
        drops = F.filter(places, lambda i: F.get(m, i) & ~before(i))

        def place(first: Column, noise: Column) -> Column:
            def span(at: Column, k: Column) -> Column:
                drop_at = F.coalesce(F.get(noise, k), F.size(m))
                end = F.coalesce(F.get(first, k + 1), F.size(m))
                return F.struct(
                    (at + 1).alias("at"), (drop_at - at).alias("keep"), (end - drop_at).alias("drop")
                )

            return F.transform(first, span)

        return bind(starts, lambda first: bind(drops, lambda noise: place(first, noise)))

    return bind(mask, spans)


def _cut_out(ids: Column, spans: Column, piece: Callable[[Column, Column, Column], Column]) -> Column:
    return bind(ids, lambda v: F.flatten(F.transform(spans, lambda s, k: piece(v, s, k))))


def corrupt_inputs(ids: Column, spans: Column, scheme: SentinelScheme) -> Column:
    """Kept ids, each dropped run replaced by one sentinel."""

    def piece(v: Column, s: Column, k: Column) -> Column:
        kept = F.slice(v, s["at"], s["keep"])
        return F.when(s["drop"] > 0, F.array_append(kept, scheme.sentinel(k))).otherwise(kept)

    return _cut_out(ids, spans, piece)


def corrupt_targets(ids: Column, spans: Column, scheme: SentinelScheme) -> Column:
    """Dropped ids, each kept run replaced by one sentinel."""

    def cut(spans: Column) -> Column:
        skipped = F.when(F.get(spans, F.lit(0))["keep"] == 0, 1).otherwise(0)

        def piece(v: Column, s: Column, k: Column) -> Column:
            dropped = F.slice(v, s["at"] + s["keep"], s["drop"])
            return F.when(s["keep"] > 0, F.concat(F.array(scheme.sentinel(k - skipped)), dropped)).otherwise(dropped)

        return _cut_out(ids, spans, piece)

    return bind(spans, cut)
