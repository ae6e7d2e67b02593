"""Source divergence audit: how far apart the vocabularies of the sources of one language are, by three-dimensional cube
partitioning.

Terms are counted by (lang, source); a language keeps the terms that stand in ``FLOOR`` of its documents. The groups of a
language are cut into blocks of ``GROUPS``, its terms into blocks of about ``TERMS`` by hash. A task owns a cell (group
block, group block, term block): it gets the two slices of counts that it needs, makes dense shares of them, and emits the
partial divergence of each pair of groups. Partial divergences are added along the term axis. The cells of the diagonal
also get the slice of the whole language, and emit the best terms of each group in their term block.

A slice holds ``GROUPS`` times about ``TERMS`` counts whatever the size of the corpus, and goes to as many cells as the
language has group blocks. Terms are counted before the first shuffle, so a source that holds a third of the documents
costs no more rows than its terms. Nothing is broadcast by name and the driver collects nothing. The groups of one
language are numbered in one task: fewer rows than the root of the result.

Shares are whole numbers, ``1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V))`` by long division in 64 bits, which is
exact while a group has under 9 * 10**15 words.

Defined cases: null text, lang and source are empty strings. A row is a document; repeated rows are documents of their
own. A group without kept terms has equal shares; in a language without kept terms all divergences are 0. A language
with one source has no pairs. Ties are ordered by the UTF-8 of the item. Long texts are counted in pieces. Other columns
are not read. An empty table has no rows in the result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import arrow_schema, slices, text_of, word_table, worded
from spanmill.session import written

FLOOR = 30
TOP = 50
SMOOTH = 5
UNIT = 10**9
GROUPS = 32
TERMS = 1024
#: Entries that a task holds before it emits its counts.
HELD = 1 << 18

#: Bytes of terms are letters and whatever is not ASCII.
TERM_BYTES = word_table(b"abcdefghijklmnopqrstuvwxyz")


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: words and documents of each term in each group; the empty term counts documents."""
    ddl = "lang string, source string, term string, n bigint, docs bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = defaultdict(Counter)
        holders: dict[tuple, Counter] = defaultdict(Counter)

        def emitted() -> Iterator[pa.RecordBatch]:
            for (lang, source), docs in holders.items():
                n = words[lang, source]
                names = pa.array(docs.keys(), pa.binary()).cast(pa.string())
                sums = [pa.array([n[t] for t in docs], pa.int64()), pa.array(docs.values(), pa.int64())]
                group = [pa.repeat(pa.scalar(v, pa.string()), len(docs)) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, names, *sums], schema=schema)
            words.clear()
            holders.clear()

        for part in slices(batches, 2):
            for lang, source, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                n, docs, seen = words[lang, source], holders[lang, source], {b""}
                for some in worded(data, TERM_BYTES):
                    n.update(some)
                    seen.update(some)
                docs.update(seen)
            if sum(map(len, holders.values())) > HELD:
                yield from emitted()
        yield from emitted()

    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))
    found = rows.mapInArrow(run, ddl)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """The whole-number shares of each row of ``counts``; three digits of the quotient at a time."""
    whole = (totals + SMOOTH * v)[:, None]
    rest, found = counts + SMOOTH, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


CELL = "lang string, part string, source string, item string, value bigint"
CELL_SCHEMA = pa.schema([(name, pa.string()) for name in ("lang", "part", "source", "item")] + [("value", pa.int64())])


def values(table: pa.Table, name: str, row: int) -> pa.StructArray | None:
    """The structs of one row's list."""
    return table.column(name)[row].values


class Slice:
    """Counts of one block of groups in one block of terms, and their shares."""

    def __init__(self, table: pa.Table, row: int):
        members, held = values(table, "members", row), values(table, "counts", row)
        self.names = members.field("source").to_pylist()
        self.counts = np.zeros((len(members), table.column("width")[row].as_py()), np.int64)
        if held is not None:
            at, pos, n = (held.field(c).to_numpy() for c in ("at", "pos", "n"))
            self.counts[at, pos] = n
        self.shares = shares(self.counts, members.field("total").to_numpy(), table.column("v")[row].as_py())


def cell(table: pa.Table) -> pa.Table:
    """The partial result of one cell from its one or two slices, and that of the language on the diagonal."""
    order = sorted(range(table.num_rows), key=table.column("block").to_pylist().__getitem__)
    whole = order.pop(0) if table.column("block")[order[0]].as_py() < 0 else None
    lang, v = table.column("lang")[0].as_py(), table.column("v")[0].as_py()
    out = []
    a, b = Slice(table, order[0]), Slice(table, order[1]) if len(order) > 1 else None
    for k, name in enumerate(a.names):
        other, first = (a, k + 1) if b is None else (b, 0)
        sums = np.abs(other.shares[first:] - a.shares[k]).sum(axis=1).tolist()
        out += [(lang, "pair", name, item, value) for item, value in zip(other.names[first:], sums, strict=True)]
    if whole is not None:
        terms = values(table, "terms", whole)
        terms = terms.take(pa.array(np.argsort(terms.field("pos").to_numpy())))
        names, total = terms.field("term"), np.array([table.column("n")[whole].as_py()], np.int64)
        more = a.shares - shares(terms.field("n").to_numpy()[None, :], total, v)
        more[a.counts == 0] = 0
        for k, name in enumerate(a.names):
            best = np.argsort(-more[k], kind="stable")[:TOP]  # positions follow the order of the terms
            out += [(lang, "term", name, names[i].as_py(), int(more[k, i])) for i in best.tolist() if more[k, i] > 0]
    columns = zip(*out) if out else [[] for _ in CELL_SCHEMA]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, CELL_SCHEMA.types)], schema=CELL_SCHEMA)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's distance from the other sources of its language
    (``pair``), and the terms that it has more of than its language (``term``)."""
    counts = written(counted(docs, text, lang, source), "term-counts")
    groups = counts.where("term = ''").select("lang", "source")
    terms = counts.where("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    kept = written(kept.where(F.col("docs") >= FLOOR).select("lang", "term", "n"), "kept-terms")
    sums = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(sums, "lang", "left")
    sizes = sizes.select("lang", "groups", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "n")))
    sizes = written(sizes.withColumn("cuts", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1))), "languages")

    place = F.row_number().over(Window.partitionBy("lang", "cut").orderBy("term")) - 1
    vocabulary = kept.join(sizes.select("lang", "cuts"), "lang").withColumn("cut", F.expr("pmod(xxhash64(term), cuts)"))
    vocabulary = written(vocabulary.select("lang", "cut", "term", "n", place.alias("pos")), "vocabulary")
    there = terms.select("lang", "source", "term", "n").join(vocabulary.drop("n"), ["lang", "term"])
    there = written(there.select("lang", "source", "cut", "pos", "n"), "kept-counts")

    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    totals = there.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    members = groups.join(totals, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), number.alias("number")
    )
    blocked = [F.expr(f"number div {GROUPS}").alias("block"), F.expr(f"int(number % {GROUPS})").alias("at")]
    members = written(members.select("lang", "source", "total", *blocked), "groups")

    # One row for each block of groups and block of terms, also where no count stands.
    block = members.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("at", "source", "total"))).alias("members"))
    held = F.collect_list(F.struct("at", "pos", "n")).alias("counts")
    packed = there.join(members, ["lang", "source"]).groupBy("lang", "block", "cut").agg(held)
    language = vocabulary.groupBy("lang", "cut").agg(F.collect_list(F.struct("pos", "term", "n")).alias("terms"))
    cuts = sizes.select("lang", "v", "n", "groups", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"(groups - 1) div {GROUPS}")))
    widths = vocabulary.groupBy("lang", "cut").agg(F.count("*").cast("int").alias("width"))
    sliced = cuts.join(widths, ["lang", "cut"], "left").join(block, "lang").join(packed, ["lang", "block", "cut"], "left")
    sliced = sliced.withColumn("other", blocks)
    first, second = F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    common = ["lang", "cut", "v", "n"]
    width = F.coalesce("width", F.lit(0)).alias("width")
    slices_of_groups = sliced.select(*common, first, second, "block", width, "members", "counts")
    slices_of_language = cuts.join(language, ["lang", "cut"]).withColumn("first", blocks).select(
        *common, "first", F.col("first").alias("second"), F.lit(-1).cast("bigint").alias("block"), "terms"
    )
    replicated = slices_of_groups.unionByName(slices_of_language, allowMissingColumns=True)
    partial = written(replicated.groupBy("lang", "first", "second", "cut").applyInArrow(cell, CELL), "cells")

    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("p"), "value").select("lang", "p.source", "p.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = partial.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*columns).union(best.select(*columns))
