"""Token ids back to text, one pass over the ids of a whole Arrow batch."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.batches import list_sizes, runs
from spanmill.functions.vocabulary import (
    BYTE_BASE,
    FINAL_BASE,
    FINALS,
    FIRST_SYLLABLE,
    INITIAL_BASE,
    SENTINEL_BASE,
    SIZE,
    VOWEL_BASE,
    VOWELS,
    special_tokens,
)

# Executors get the batch function with its code and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _alone() -> list[bytes]:
    """The bytes of each id that stands alone; stray letters print as U+0100 and up."""
    literals = {i: token.encode() for token, i in special_tokens().items()}
    plain = lambda i: bytes([i - BYTE_BASE]) if i < INITIAL_BASE else chr(i - BYTE_BASE).encode()
    return [literals.get(i) or plain(i) for i in range(SIZE)]


def _text_of_batch(lists: pa.Array, bare: bool = False) -> pa.Array:
    """The texts of a batch of id lists; ``bare`` leaves out special and sentinel ids."""
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if bare:
        kept = (ids >= BYTE_BASE) & (ids < SENTINEL_BASE)
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        ids = ids[kept]
    spelled = _alone()
    known = (ids >= 0) & (ids < SIZE)
    lengths = np.where(known, np.array([len(s) for s in spelled])[np.where(known, ids, 0)], 0)

    # An initial, a vowel and a final of one list are the three bytes of a syllable.
    first = np.flatnonzero((ids >= INITIAL_BASE) & (ids < VOWEL_BASE))
    first = first[first + 2 < len(ids)]
    vowel, final = ids[first + 1], ids[first + 2]
    joined = (vowel >= VOWEL_BASE) & (vowel < FINAL_BASE) & (final >= FINAL_BASE) & (final < SENTINEL_BASE)
    joined &= np.searchsorted(ends, first, side="right") == np.searchsorted(ends, first + 2, side="right")
    first = first[joined]
    code = ((ids[first] - INITIAL_BASE) * VOWELS + vowel[joined] - VOWEL_BASE) * FINALS + final[joined] - FINAL_BASE + FIRST_SYLLABLE
    lengths[first] = 3
    lengths[first + 1] = lengths[first + 2] = 0
    at = np.concatenate([[0], np.cumsum(lengths)])

    raw = np.zeros(at[-1], np.uint8)
    is_byte = (ids >= BYTE_BASE) & (ids < INITIAL_BASE)
    raw[at[:-1][is_byte]] = ids[is_byte] - BYTE_BASE
    for k, byte in enumerate((code >> 12 | 0xE0, code >> 6 & 0x3F | 0x80, code & 0x3F | 0x80)):
        raw[at[first] + k] = byte
    others = np.flatnonzero(known & ~is_byte & (lengths > 0))
    others = others[~np.isin(others, first, assume_unique=True)]
    for i in np.unique(ids[others]):
        places = at[others[ids[others] == i]]
        for k, byte in enumerate(spelled[i]):
            raw[places + k] = byte

    bounds = at[ends]
    return _valid(raw, bounds, lists.is_null() if lists.null_count else None)


def _valid(raw: np.ndarray, bounds: np.ndarray, missing: pa.Array | None) -> pa.Array:
    """Bytes to texts; undecodable bytes vanish, a U+FFFD that was in the text stays."""
    data = raw.tobytes()
    begins = raw[bounds[:-1][bounds[:-1] < bounds[1:]]]
    try:
        data.decode()
        whole = not ((begins & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        texts = pa.Array.from_buffers(
            pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data)]
        )
    else:
        cut = (data[a:b].decode(errors="ignore") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        texts = pa.array(list(cut), pa.large_string())
    texts = texts.cast(pa.string())
    return texts if missing is None else pa.compute.if_else(missing, pa.scalar(None, pa.string()), texts)


def _texts(bare: bool, ids: Column | str) -> Column:
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for run in runs(list_sizes(lists)):
                yield _text_of_batch(lists.slice(*run), bare)

    return F.arrow_udf(texts, T.StringType())(ids)


def decode_ids(ids: Column | str) -> Column:
    """Token ids to text: letter triples rejoin to syllables, special ids print as literals."""
    return _texts(False, ids)


def decode_bytes(ids: Column | str) -> Column:
    """As :func:`decode_ids`, but special and sentinel ids leave no trace in the text."""
    return _texts(True, ids)
