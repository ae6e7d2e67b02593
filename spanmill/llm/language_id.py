"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts. A text is compressed with each, in pieces of
``PIECE`` bytes that all start from the dictionary alone, and the sizes are summed; the dictionary that makes it smallest
names the language. Where the two smallest results lie close together the answer is rejected. A dictionary saves about as
much in every piece, so the length of a text does not enter into the margin.

Texts so short that no dictionary makes them smaller have equal sizes. These are told apart by the runs of ``GRAM`` bytes
that they share with each dictionary, common ones counting more.

Texts are compared by their letters: lower case, every run of ASCII characters that are no letters one space.

Defined cases: a text that is null or holds no letter is ``und`` with score 0 and is rejected. What is equal by that, too,
or equal in size though smaller than the text, goes to the language that comes first by name, with score 0. Null or empty training texts and null languages teach nothing; without
any training text every answer is ``und``. Repeated training texts count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import keep_rows, map_texts, text_of

UNKNOWN = "und"
PARTS = 256
#: Bytes compressed from a fresh dictionary, and bytes of a run.
PIECE = 4096
GRAM = 4


@dataclass(frozen=True)
class Parameters:
    """``samples`` texts are taken for each language, of each at most ``sample_chars`` characters from a place that the hash of
    the text chooses: the only bounded sample.

    ``min_margin`` is the least share by which the best language must be smaller than the second.
    """

    samples: int = 160
    sample_chars: int = 800
    min_margin: float = 0.001


LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(lowered: bytes) -> bytes:
    """One space for every run of ASCII characters that are no letters, and one at both ends."""
    return b" %b " % b" ".join(lowered.translate(LETTERS).split())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def least(hashes: DataFrame, by: list[str], n: int) -> DataFrame:
    """The rows with the ``n`` least hashes of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
    return hashes.withColumn("place", place).where(F.col("place") <= n).drop("place")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", p: Parameters = Parameters()) -> dict[str, bytes]:
    """A dictionary for each language from the ``samples`` texts whose hashes are smallest."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn("hash", F.xxhash64("text"))
    # The least of each of many parts of a language, then the least of these: no task ranks all texts of a language.
    hashes = rows.select("lang", "hash").distinct().withColumn("part", F.pmod("hash", F.lit(PARTS)))
    chosen = least(least(hashes, ["lang", "part"], p.samples), ["lang"], p.samples).select("lang", "hash")
    places = F.greatest(F.length("text") - p.sample_chars + 1, F.lit(1))
    place = (F.pmod(F.xxhash64(F.lit("place"), "text"), places) + 1).cast("int")
    sample = rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(
        F.min(F.lower(text_of(F.substring(F.col("text"), place, F.lit(p.sample_chars))))).alias("text")
    )
    made: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["hash"])):  # languages x samples x sample_chars at most
        made.setdefault(row["lang"], []).append(letters(row["text"].encode()))
    return {name: b"".join(texts) for name, texts in made.items()}


def grams(text: bytes) -> np.ndarray:
    """A number for every run of ``GRAM`` bytes."""
    at = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = max(0, len(at) - GRAM + 1)
    return sum((at[k : k + n] << np.uint32(8 * k) for k in range(GRAM)), np.zeros(n, np.uint32))


class Dictionary:
    """The settings look for matches of four bytes and up and leave everything but content out."""

    def __init__(self, name: str, content: bytes):
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=15, chain_log=15, search_log=4,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.name, self.content = name, content
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=settings)
        self.compressor = zstandard.ZstdCompressor(dict_data=shared, compression_params=settings)

    def size(self, text: bytes) -> int:
        """Bytes of all pieces, each compressed by itself."""
        whole = memoryview(text)
        return sum(len(self.compressor.compress(whole[k : k + PIECE])) for k in range(0, len(whole), PIECE))

    @cached_property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the dictionary in order, and how much each counts."""
        runs, n = np.unique(grams(self.content), return_counts=True)
        return runs, np.log2(1 + n)

    def shared(self, text: bytes) -> float:
        """Sum of the weights of the runs that a text shares with the dictionary."""
        runs, weights = self.weights
        total = 0.0
        for k in range(0, len(text) if len(runs) else 0, PIECE):
            own = grams(text[k : k + PIECE + GRAM - 1])
            place = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            total += float(weights[place][runs[place] == own].sum())
        return total


def compressors(dictionaries: dict[str, bytes]) -> list[Dictionary]:
    """In order of name."""
    return [Dictionary(name, dictionaries[name]) for name in sorted(dictionaries)]


def classify(text: bytes, by_name: list[Dictionary]) -> tuple[str, float]:
    """The language that compresses best, and the share by which the second needs more.

    If no dictionary makes the text smaller: the one that shares most with it, and the share by which the second has less.
    """
    sizes = [d.size(text) for d in by_name]
    if len(by_name) < 2:
        return by_name[0].name, 1.0
    best, second = sorted(sizes)[:2]
    if best == second and best >= len(text):
        tied = [d for d, size in zip(by_name, sizes, strict=True) if size == best]
        most = sorted(((d.shared(text), d) for d in tied), key=lambda x: -x[0])
        return most[0][1].name, 1 - most[1][0] / most[0][0] if most[0][0] else 0.0
    return by_name[sizes.index(best)].name, 1 - best / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keys: list[Column], schema: str, text: str = "text") -> DataFrame:
    """``keys`` (as ``schema`` names them), then lang_pred string, score double. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def start():
        by_name = compressors(shared.value)

        def work(texts: pa.Array, known: pa.Array, *kept: pa.Array) -> list:
            found = [
                classify(letters(t), by_name) if k and by_name else (UNKNOWN, 0.0)
                for t, k in zip(texts.to_pylist(), known.to_pylist(), strict=True)
            ]
            return [*kept, [f[0] for f in found], [f[1] for f in found]]

        return work

    whole = F.lower(text_of(text))
    inputs = [whole.cast("binary"), has_letter(whole), *keys]
    return map_texts(docs, inputs, f"{schema}, lang_pred string, score double", start, text=0)


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in five, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, p: Parameters = Parameters()) -> dict[str, bytes]:
    """Dictionaries from the documents that are not held out."""
    return fit(docs.where(~held_out()), p=p)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", p: Parameters = Parameters()) -> DataFrame:
    """The documents, with all their columns, whose language is found by a margin of at least ``min_margin``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def start():
        by_name = compressors(shared.value)

        def work(texts: pa.Array, known: pa.Array) -> list[bool]:
            return [
                bool(k and by_name) and classify(letters(t), by_name)[1] >= p.min_margin
                for t, k in zip(texts.to_pylist(), known.to_pylist(), strict=True)
            ]

        return work

    whole = F.lower(text_of(text))
    return keep_rows(docs, [whole.cast("binary"), has_letter(whole)], start)
