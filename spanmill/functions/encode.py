"""Text to token ids with column expressions.

A Hangul syllable takes three UTF-8 bytes and three letter ids, so for text
without special tokens ``size(ids) == octet_length(text)``. Plans use that to
size and place token runs before anything is tokenised.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.batches import AT_ONCE, packed, squeezed, text_parts
from spanmill.functions.binding import bind
from spanmill.functions.vocabulary import (
    BYTE_BASE,
    EOS,
    EOS_TOKEN,
    FINAL_BASE,
    FINALS,
    FIRST_SYLLABLE,
    INITIAL_BASE,
    LAST_SYLLABLE,
    PAD,
    PAD_TOKEN,
    SENTINEL_BASE,
    SENTINELS,
    UNK,
    UNK_TOKEN,
    VOWEL_BASE,
    VOWELS,
    special_tokens,
)

# Executors get the batch function with its code and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYLLABLE_CLASS = f"[{chr(FIRST_SYLLABLE)}-{chr(LAST_SYLLABLE)}]"


def _no_ids() -> Column:
    return F.array().cast("array<int>")


def byte_ids(text: Column | str, pack: bool = False) -> Column:
    """UTF-8 byte + 3 for each byte. With ``pack`` they are packed, one Arrow pass over the bytes of many texts; else an expression."""
    text = F.col(text) if isinstance(text, str) else text
    if pack:

        def packed_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield from (packed(ids_of_batch(part, byte_values)) for part in text_parts(texts))

        return F.arrow_udf(packed_ids, T.BinaryType())(F.make_valid_utf8(text))

    def ids(t: Column) -> Column:
        # Read as Latin-1, each byte is one character whose code point is the byte.
        chars = F.split(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), "")
        return F.when(t == "", _no_ids()).otherwise(F.transform(chars, lambda c: F.ascii(c) + BYTE_BASE))

    return bind(text, ids)


def _continuation(bits: Column) -> Column:
    return bits.bitwiseAND(0x3F) + (0x80 + BYTE_BASE)


def _character_ids(code: Column) -> Column:
    syllable = code - FIRST_SYLLABLE
    per_initial = VOWELS * FINALS
    return (
        F.when(code < 0x80, F.array(code + BYTE_BASE))
        .when(
            code.between(FIRST_SYLLABLE, LAST_SYLLABLE),
            F.array(
                (syllable / per_initial).cast("int") + INITIAL_BASE,
                ((syllable % per_initial) / FINALS).cast("int") + VOWEL_BASE,
                syllable % FINALS + FINAL_BASE,
            ),
        )
        .when(code < 0x800, F.array(F.shiftright(code, 6) + (0xC0 + BYTE_BASE), _continuation(code)))
        .when(
            code < 0x10000,
            F.array(
                F.shiftright(code, 12) + (0xE0 + BYTE_BASE),
                _continuation(F.shiftright(code, 6)),
                _continuation(code),
            ),
        )
        .otherwise(
            F.array(
                F.shiftright(code, 18) + (0xF0 + BYTE_BASE),
                _continuation(F.shiftright(code, 12)),
                _continuation(F.shiftright(code, 6)),
                _continuation(code),
            )
        )
    )


def letter_ids(text: Column | str, pack: bool = False, squeeze: bool = False) -> Column:
    """As :func:`byte_ids`, but a Hangul syllable becomes initial, vowel, final.

    One Arrow pass over the bytes of many texts, with no step for each text
    or character: about twice as fast as :func:`letter_ids_expr`. Ids go back
    by the megabyte of text, so a task never holds those of a whole batch. With ``pack`` they are packed, with ``squeeze``
    compressed too, row by row.
    """

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = map(letters_of_batch, text_parts(texts))
            yield from (squeezed(packed(part)) for part in made) if squeeze else map(packed, made) if pack else made

    return F.arrow_udf(ids, T.BinaryType() if pack or squeeze else T.ArrayType(T.IntegerType()))(text)


def byte_values(raw: np.ndarray) -> np.ndarray:
    """The id of each byte."""
    return np.add(raw, BYTE_BASE, dtype=np.int32)


def letter_values(raw: np.ndarray) -> np.ndarray:
    """The id of each byte, or of the letter in its place if it belongs to a whole syllable."""
    ids = byte_values(raw)
    for start in range(0, len(raw) - 2, AT_ONCE):
        leads = raw[start : min(start + AT_ONCE, len(raw) - 2)]  # two bytes follow each
        lead = np.flatnonzero((leads >= 0xEA) & (leads <= 0xED)) + start  # from U+A000 to U+DFFF
        bits = [raw[lead + k].astype(np.int32) for k in range(3)]
        code = (bits[0] & 0x0F) << 12 | (bits[1] & 0x3F) << 6 | bits[2] & 0x3F
        found = (code >= FIRST_SYLLABLE) & (code <= LAST_SYLLABLE) & (bits[1] >> 6 == 2) & (bits[2] >> 6 == 2)
        lead, syllable = lead[found], code[found] - FIRST_SYLLABLE
        ids[lead] = INITIAL_BASE + syllable // (VOWELS * FINALS)
        ids[lead + 1] = VOWEL_BASE + syllable % (VOWELS * FINALS) // FINALS
        ids[lead + 2] = FINAL_BASE + syllable % FINALS
    return ids


def letters_of_batch(texts: pa.Array) -> pa.Array:
    return ids_of_batch(texts, letter_values)


def ids_of_batch(texts: pa.Array, values: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The ids lie where the bytes lie, so the offsets of the texts are those of their ids."""
    texts = texts.cast(pa.string())  # with large or view types, offsets would have another width
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return pa.ListArray.from_arrays(
        pa.array(ends - ends[0], pa.int32()), pa.array(values(raw), pa.int32()), mask=texts.is_null() if texts.null_count else None
    )


def letter_ids_expr(text: Column | str) -> Column:
    """As :func:`letter_ids`, in column expressions alone.

    These may stand inside a lambda, and unlike a function in Python they keep
    the partitioning of what they are computed from.
    """
    text = F.col(text) if isinstance(text, str) else text

    def ids(t: Column) -> Column:
        codes = F.transform(F.split(t, ""), lambda c: F.ascii(c))
        spelled = F.flatten(F.transform(codes, _character_ids))
        return F.when(t.rlike(SYLLABLE_CLASS), spelled).otherwise(byte_ids(t))

    return bind(text, ids)


def first_ids(text: Column | str, length: int, encode: Callable[[Column], Column] = letter_ids) -> Column:
    """``slice(encode(text), 1, length)`` for a long text, without encoding what is cut off anyway.

    Every character gives at least one id, so the first ``length`` ids never
    reach beyond the first ``length`` characters. Not for :func:`special_letter_ids`.
    """
    return F.slice(encode(F.substring(text, 1, length)), 1, length)


def special_pieces(sentinels: int = SENTINELS) -> str:
    """Pattern of one special token, or a run of other characters, or a lone '<'."""
    return "|".join([*special_tokens(sentinels), "[^<]+", "<"])


def special_letter_ids(text: Column | str, sentinels: int = SENTINELS) -> Column:
    """As :func:`letter_ids`, but literal special tokens inside the text become one id each.

    As there, one pass over the bytes of many texts; only where a special token stands is anything done for it.
    """

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in text_parts(texts):
                yield special_letters_of_batch(part, sentinels)

    return F.arrow_udf(ids, T.ArrayType(T.IntegerType()))(text)


def special_letters_of_batch(texts: pa.Array, sentinels: int = SENTINELS) -> pa.Array:
    """The ids of the bytes, in which the first byte of a token becomes its id and the others go."""
    texts = texts.cast(pa.string())
    plain = letters_of_batch(texts)
    ids, ends = plain.values.to_numpy().copy(), plain.offsets.to_numpy()
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(data)[starts[0] : starts[-1]] if data is not None else b""
    tokens = special_tokens(sentinels)
    found = [(m.start(), m.end(), tokens[m[0].decode()]) for m in re.finditer("|".join(map(re.escape, tokens)).encode(), raw)]
    if not found:
        return plain
    at, stop, token = (np.array(c, np.int64) for c in zip(*found))
    text = np.searchsorted(ends, at, side="right")  # a token does not reach into the next text
    inside = stop <= ends[np.minimum(text, len(ends) - 1)]
    at, stop, token = at[inside], stop[inside], token[inside]
    ids[at] = token
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, at + 1, 1)
    np.add.at(gone, stop, -1)
    keep = np.cumsum(gone[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(
        pa.array(before[ends], pa.int32()), pa.array(ids[keep], pa.int32()), mask=texts.is_null() if texts.null_count else None
    )


def special_letter_ids_expr(text: Column | str, sentinels: int = SENTINELS) -> Column:
    """As :func:`special_letter_ids`, in column expressions alone."""
    text = F.col(text) if isinstance(text, str) else text

    def piece_ids(piece: Column) -> Column:
        named = (
            F.when(piece == EOS_TOKEN, EOS)
            .when(piece == UNK_TOKEN, UNK)
            .when(piece == PAD_TOKEN, PAD)
            .otherwise(F.regexp_extract(piece, "[0-9]+", 0).try_cast("int") + SENTINEL_BASE)
        )
        is_special = (F.char_length(piece) > 1) & piece.startswith("<")
        return F.when(is_special, F.array(named)).otherwise(letter_ids_expr(piece))

    pieces = F.regexp_extract_all(text, F.lit(f"({special_pieces(sentinels)})"), F.lit(1))
    return F.flatten(F.transform(pieces, piece_ids))


#: What gives the ids of :func:`byte_ids`, :func:`letter_ids` or :func:`letter_ids_expr` from the bytes of a text, or of a part of it
#: with two bytes more on both sides.
VALUES = {byte_ids: byte_values, letter_ids: letter_values, letter_ids_expr: letter_values}
