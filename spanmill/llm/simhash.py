"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Fingerprints are found by a segment-popcount embedding. The bits are cut into 16 segments of four, and a fingerprint
becomes the vector of its segments' bit counts. One differing bit moves one count by at most one, so the Manhattan
distance of two vectors is a lower bound of the number of differing bits. The vectors lie on a grid; each fingerprint
enters its own cell and the cells one step away, and two fingerprints within a distance of two meet in a cell. Those that
meet are verified bit by bit.

A cell in which more than ``CELL`` fingerprints meet, as around a text with thousands of near copies, is not compared
pair by pair. Its fingerprints enter a finer grid, of the fingerprints themselves: each with every single bit flipped.
Whoever shares a point there differs by two bits at most, and whoever differs by two bits at most shares one; all of a
point are linked to its least, so the work is in proportion to the fingerprints and no pair is left out.

Cells and points are tables of up to 33 and 65 rows for each fingerprint, which Spark takes for as small as that of the
fingerprints, so these joins and those of all documents are told to be merges: no such table is ever broadcast.

Exact copies have one fingerprint and are one row from then on.

Defined cases: a null text counts as empty. A text without words has fingerprint zero and is linked like any other.
Rows with the same id are grouped each by its own text, so that a text goes only where a copy of it stays; of equal rows one
stays. A null id takes part in the links but never names a component, unless no id is there. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_texts, text_of
from spanmill.llm.components import components
from spanmill.session import written

WORDS = 3
SEED = 42
SEGMENTS = 16
CELL = 64
MASS = 1 << 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: bytes, words: int = WORDS) -> list[int]:
    """The hash of every shingle, repeats included; the whole sequence is one shingle if it is shorter."""
    split = text.translate(LOWER).split()  # on space and the five ASCII controls 9 to 13
    if not split:
        return []
    width = min(words, len(split))
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(b" ".join, zip(*(split[k:] for k in range(width)), strict=False))]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is set if it is set in over half the hashes. Signed, as Spark holds it."""
    found = np.array(hashes(text, words), dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(found), MASS):
        some = found[start : start + MASS]
        counts += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(found))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, bits, version``, one row for each row of ``docs``; one pass, no shuffle. ``version``: hash of the text."""

    def start():
        def work(ids: pa.Array, texts: pa.Array, versions: pa.Array) -> list:
            return [ids, [fingerprint(t) for t in texts.to_pylist()], versions]

        return work

    inputs = [F.col(doc_id).cast("bigint"), text_of(text).cast("binary"), F.xxhash64(text_of(text))]
    return map_texts(docs, inputs, "doc_id bigint, bits bigint, version bigint", start)


def _cells(bits: Column) -> Column:
    """The cell of a fingerprint's vector, counts packed by three bits, and the cells one step away."""
    counts = [F.bit_count(F.shiftrightunsigned(bits, 4 * k).bitwiseAND(F.lit(15))).cast("bigint") for k in range(SEGMENTS)]
    own = sum((F.shiftleft(c, 3 * k) for k, c in enumerate(counts)), F.lit(0).cast("bigint"))
    lower = [F.when(c > 0, own - F.lit(1 << 3 * k)) for k, c in enumerate(counts)]
    upper = [F.when(c < 4, own + F.lit(1 << 3 * k)) for k, c in enumerate(counts)]
    return F.array_compact(F.array(own, *lower, *upper))


def _flips(bits: Column) -> Column:
    """The fingerprint, and with each bit flipped."""
    masks = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)], F.lit(0).cast("bigint"))
    return F.transform(masks, lambda m: bits.bitwiseXOR(m))


def links(distinct: DataFrame, differing: int = 2) -> DataFrame:
    """``a, b``: links between the fingerprints of ``distinct(bits)`` that connect whoever differs by two bits at most."""
    if differing != 2:
        raise ValueError("the grids are those of two differing bits")
    tasks = max(1, distinct.count() >> 14)  # each row becomes many: more tasks than the size of the table suggests
    rows = distinct.select("bits").repartition(tasks).select("bits", F.explode(_cells(F.col("bits"))).alias("cell"))
    met = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(met.hint("merge"), "cell"), "cells")

    group = rows.where(F.col("n") <= CELL).groupBy("cell").agg(F.array_sort(F.collect_list("bits")).alias("all"))
    pairs = group.select(
        F.explode(
            F.expr(
                "flatten(transform(all, (x, i) -> transform("
                f"filter(slice(all, i + 2, {CELL}), y -> bit_count(x ^ y) <= {differing}), y -> struct(x as a, y as b))))"
            )
        ).alias("pair")
    ).select("pair.a", "pair.b")
    dense = rows.where(F.col("n") > CELL).select("bits").distinct()
    points = dense.select("bits", F.explode(_flips(F.col("bits"))).alias("point"))
    first = points.groupBy("point").agg(F.min("bits").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(first.hint("merge"), "point").where("bits <> a").select("a", F.col("bits").alias("b"))
    return pairs.union(stars).distinct()


def grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, bits, version, root, component_id`` for every row."""
    marked = written(fingerprints(docs, doc_id, text), "fingerprints")
    classes = written(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("bits")))
    rooted = classes.join(roots.hint("merge"), classes["bits"] == roots["node"], "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_bits = rooted.join(named, "root").select("bits", "root", "component_id")
    return marked.join(by_bits.hint("merge"), "bits").select("doc_id", "bits", "version", "root", "component_id")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, bits, component_id``: the least id that can be reached over links, its own included."""
    return grouped(docs, doc_id, text).select("doc_id", "bits", "component_id")


def spelled(bits: str | Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(bits) if isinstance(bits, str) else bits)), 16, "0")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document, with all its columns, of each group: the one that names it, of a group without ids any one text.

    What goes is decided by id and text. Of several rows with the id and the text that stay, the least by its columns
    stays; these are put together by an aggregate, so a third of all rows may be one row repeated.
    """
    found = written(grouped(docs, doc_id, text), "grouped")
    leads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = leads.groupBy("root").agg(F.min("version").alias("chosen"))
    rows = found.join(chosen, "root").groupBy("root", "doc_id", "version", "component_id", "chosen").agg(F.count("*").alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("version") == F.col("chosen"))
    fate = rows.where(~stays | (F.col("n") > 1)).select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version"), stays.alias("_stays")
    )
    fate = written(fate, "fate")
    same = docs[doc_id].cast("bigint").eqNullSafe(fate["_id"]) & (F.xxhash64(text_of(docs[text])) == fate["_version"])
    single = docs.join(fate, same, "left_anti")
    again = docs.join(fate.where("_stays"), same).groupBy("_id", "_version").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_row"))
    return single.union(again.select("_row.*"))
