"""Arrow batches a part at a time: what a step holds beside its batch does not grow with the batch."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text, or ids, that are worked on at a time. Spark's batches of up to 64 MB become 256 MB of ids, and several times that in between.
AT_ONCE = 1 << 20

#: How an id is packed; no vocabulary here has 65,536. The higher byte is first, so packed ids sort as arrays of them do.
PACKED = np.dtype(">u2")


def runs(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs that hold ``most`` or less together; a larger row is a run of its own."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = before = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop - start
        start, before = stop, int(ends[stop - 1])


def text_parts(texts: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """The texts, ``most`` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return (texts.slice(*run) for run in runs(sizes, most))


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Length of each list, or of each packed one; 0 where there is none."""
    if pa.types.is_binary(lists.type):
        return pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) // PACKED.itemsize
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(lists: pa.ListArray) -> pa.Array:
    """Each list of ids as bytes, two for an id: Spark and Parquet move these whole, and the ids of an array one by one."""
    ends = np.concatenate([[0], np.cumsum(list_sizes(lists))]) * PACKED.itemsize
    data = lists.flatten().to_numpy(zero_copy_only=False).astype(PACKED)
    missing = lists.is_valid().buffers()[1] if lists.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(lists), [missing, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def squeezed(packs: Iterable[pa.Scalar | bytes | None]) -> pa.Array:
    """Packed ids of each row compressed, after four bytes that say how many there are: a third of what arrays of them shuffle."""
    codec = pa.Codec("zstd", compression_level=3)
    raw = (v.as_py() if isinstance(v, pa.Scalar) else v for v in packs)
    rows = [None if v is None else (len(v) // PACKED.itemsize).to_bytes(4, "big") + codec.compress(v, asbytes=True) for v in raw]
    return pa.array(rows, pa.binary())


def unsqueezed(row: bytes) -> bytes:
    """The packed ids that were compressed."""
    return pa.Codec("zstd").decompress(row[4:], int.from_bytes(row[:4], "big") * PACKED.itemsize, asbytes=True)


def as_lists(ids: pa.Array) -> pa.Array:
    """The lists that were packed; lists stay as they are."""
    if not pa.types.is_binary(ids.type):
        return ids
    ends = np.concatenate([[0], np.cumsum(list_sizes(ids))])
    _, offsets, data = ids.buffers()
    first = np.frombuffer(offsets, np.int32)[ids.offset] if len(ids) else 0
    flat = np.frombuffer(data, PACKED, int(ends[-1]), int(first)) if ends[-1] else np.empty(0, PACKED)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)), mask=ids.is_null() if ids.null_count else None)
