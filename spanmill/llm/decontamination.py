"""Benchmark decontamination with suffix arrays of the training texts.

A shard is a slice of documents. Its suffix array holds the word positions at which a benchmark window could begin,
sorted by the words that follow; positions whose next words do not all occur in the benchmark cannot match and stay out.
Every distinct window of the benchmark is looked up by binary search, which gives all its occurrences in the shard. Its
items are named afterwards, once for each stretch of windows, however many documents have that stretch; occurrences that
follow each other on both sides make up the longest verbatim matches. No document is shuffled.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. Words are runs
of digits, a-z after lower-casing A-Z, and characters beyond ASCII.

The benchmark reaches the shards without repeated rows, in blocks of about ``BLOCK_BYTES`` of text, found by a sum first. One
block is one pass over the documents; with more, each pass adds to what the passes before it have found.

Defined cases: a null or empty text has no words and is clean. A null item id is named ``null``. Rows with the same item
id are one item, each row with its own windows. An empty benchmark hits nothing. Repeated documents are judged each by
itself. Of several longest matches the one that starts first is given, and of items that share it the least by name. Names of other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanmill.llm.common import slices, text_of
from spanmill.session import written

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
STRETCHES = 1 << 10  # remembered at once
WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "hits array<int>, items array<string>, longest int, longest_start int, longest_item string"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD).split()


class Windows:
    """The windows of a block of items, sorted as keys of four bytes a word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        numbers = [
            np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            for _, text in items
        ]
        # Digits to the base 254, from 1 to 254: no zero byte, which numpy would cut off, and 255 is free as an end mark.
        number = np.arange(len(self.vocabulary) + 1)
        self.codes = np.stack([number // 254**k % 254 + 1 for k in (3, 2, 1, 0)], axis=1).astype(np.uint8)
        self.codes[0] = 0
        self.shortest = np.full(len(number), np.iinfo(np.int32).max, dtype=np.int64)
        places = []  # key, length, row of the item, word in it
        for row, ids in enumerate(numbers):
            if len(ids):
                length = min(window, len(ids))
                starts = np.arange(len(ids) - length + 1)
                np.minimum.at(self.shortest, ids[starts], length)
                places.append((self.keys(ids, starts, np.full(len(starts), length)), length, row, starts))
        key = np.concatenate([p[0] for p in places]) if places else np.empty(0, f"S{4 * window}")
        length = np.concatenate([np.full(len(p[0]), p[1]) for p in places]) if places else np.empty(0, np.int64)
        row = np.concatenate([np.full(len(p[0]), p[2]) for p in places]) if places else np.empty(0, np.int64)
        at = np.concatenate([p[3] for p in places]) if places else np.empty(0, np.int64)
        # Equal windows are one; its places in items are those from first[window] to first[window + 1].
        self.key, index, window_of = np.unique(key, return_index=True, return_inverse=True)
        self.length = length[index]
        order = np.argsort(window_of, kind="stable")
        self.row, self.at = row[order], at[order]
        self.first = np.searchsorted(window_of[order], np.arange(len(self.key) + 1))

    def keys(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first words, at most a window, of the suffixes that begin at ``starts`` and have ``lengths`` words."""
        step = np.arange(self.window)
        inside = step < lengths[:, None]
        taken = np.where(inside, ids[np.minimum(starts[:, None] + step, len(ids) - 1)], 0)
        return self.codes[taken].reshape(len(starts), 4 * self.window).view(f"S{4 * self.window}").ravel()

    def search(self, shard: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``window, position``: all occurrences in the word numbers of a shard whose documents end at ``ends``."""
        none = np.empty(0, np.int64)
        if not len(self.key) or not len(shard):
            return none, none
        known = np.flatnonzero(self.shortest[shard] <= self.window)
        breaks = np.unique(np.concatenate([np.flatnonzero(shard == 0), ends]))
        run = breaks[np.searchsorted(breaks, known, side="right")] - known
        fit = run >= self.shortest[shard[known]]
        suffixes, run = known[fit], run[fit]
        keys = self.keys(shard, suffixes, run)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[order], keys[order]
        low = np.searchsorted(keys, self.key, side="left")
        beyond = np.where(self.length < self.window, np.char.add(self.key, b"\xff").astype(self.key.dtype), self.key)
        high = np.searchsorted(keys, beyond, side="right")
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return which, suffixes[rank]

    def matches(self, which: np.ndarray, at: np.ndarray) -> tuple[list[str], tuple[int, int, str]]:
        """The items of the windows found at the places of a stretch, and ``-length, start, item`` of its longest match."""
        n = self.first[which + 1] - self.first[which]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[which], n)
        at, length, row = np.repeat(at, n), np.repeat(self.length[which], n), self.row[place]
        diagonal = at - self.at[place]
        # Occurrences that go on by one word in the item and in the document are one match.
        order = np.lexsort((at, diagonal, row))
        at, row, length, diagonal = at[order], row[order], length[order], diagonal[order]
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = (row[1:] != row[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(at)) - 1
        start, size, item = at[first], at[last] + length[last] - at[first], row[first]
        best = np.flatnonzero(size == size.max())
        best = best[start[best] == start[best].min()]
        names = sorted({self.names[k] for k in np.unique(item).tolist()})
        return names, (-int(size[best[0]]), int(start[best[0]]), min(self.names[k] for k in item[best].tolist()))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[int], list[str], tuple[int, int, str] | None]]:
        """For each text: number of words, bounds of the hit stretches, items found, longest match with its place."""
        get = self.vocabulary.get
        numbers = [np.array([get(w, 0) for w in words(t)], dtype=np.int32) for t in texts]
        sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        ends = np.cumsum(sizes)
        out = [(int(size), [], [], None) for size in sizes]
        which, at = self.search(np.concatenate(numbers) if numbers else np.empty(0, np.int32), ends)
        if not len(which):
            return out
        order = np.lexsort((which, at))
        which, at = which[order], at[order]
        doc = np.searchsorted(ends, at, side="right")
        breaks = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)) + 1
        known: dict[tuple[bytes, bytes], tuple] = {}
        for mine in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1):
            d = int(doc[mine[0]])
            offset = int(ends[d] - sizes[d])
            own, names = [], set()
            low, high = np.searchsorted(breaks, (mine[0] + 1, mine[-1] + 1))
            for part in np.split(mine, breaks[low:high] - mine[0]):
                begin = int(at[part[0]])
                key = which[part].tobytes(), (at[part] - begin).tobytes()
                if key not in known:
                    if len(known) >= STRETCHES:
                        known.clear()
                    known[key] = self.matches(which[part], at[part] - begin)
                items, (size, start, item) = known[key]
                names.update(items)
                own.append((size, start + begin - offset, item))
            best = min(own)
            hits = zip((at[mine] - offset).tolist(), (at[mine] + self.length[which[mine]] - offset).tolist(), strict=True)
            out[d] = (out[d][0], joined(hits), sorted(names), (-best[0], best[1], best[2]))
        return out


def joined(stretches: Iterator[tuple[int, int]]) -> list[int]:
    """Bounds ``start, end, start, end ...`` of the union of stretches."""
    out: list[int] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_bytes``; the driver holds one at a time."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), text_of(text).cast("binary").alias("text")
    )
    items = written(items.distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield sorted((r["name"], bytes(r["text"])) for r in part.collect())


def scanned(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """The documents with one more struct column, whose name is returned: ``n_words, hits, items, longest ...``."""
    name = "_" * (1 + max(map(len, docs.columns))) + "found"
    kind = StructType.fromDDL(f"n_words int, {FOUND}")
    empty = F.struct(
        F.lit(0).alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
        F.lit(0).alias("longest"), F.lit(None).cast("int").alias("longest_start"),
        F.lit(None).cast("string").alias("longest_item"),
    )
    now = docs.withColumn(name, empty.cast(kind)).withColumn(name + "text", text_of(text).cast("binary"))
    fields = [("n_words", pa.int32()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32())]
    arrow = pa.struct([*fields, ("longest_start", pa.int32()), ("longest_item", pa.string())])
    width = len(docs.columns)
    for k, block in enumerate(blocks(benchmark, item_id, item_text, block_bytes)):
        now = written(now, "scanned") if k else now
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value)
            for part in slices(batches, width + 1, SHARD_BYTES):
                found = windows.find(part.column(width + 1).to_pylist())
                column = [merged(a, b) for a, b in zip(part.column(width).to_pylist(), found, strict=True)]
                columns = [*part.columns[:width], pa.array(column, arrow), part.column(width + 1)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        now = now.mapInArrow(run, now.schema)
    return now.drop(name + "text"), name


def merged(before: dict, found: tuple) -> dict:
    """What the earlier blocks and this one have found in a document."""
    n_words, hits, items, longest = found
    own = longest or (0, None, None)
    past = (before["longest"], before["longest_start"], before["longest_item"])
    best = past if past[0] >= own[0] else own
    pairs = before["hits"] + hits
    return {
        "n_words": n_words, "hits": joined(zip(pairs[::2], pairs[1::2], strict=True)),
        "items": sorted({*before["items"], *items}),
        "longest": best[0], "longest_start": best[1], "longest_item": best[2],
    }


def n_hit(found: Column) -> Column:
    ends = F.aggregate(found["hits"], F.lit(0).cast("bigint"), lambda total, x: x - total)
    return F.coalesce(ends, F.lit(0).cast("bigint"))


def contaminated(found: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, the stretches, and the longest match."""
    found, name = scanned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **names)
    at = F.col(name)
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), at["n_words"].cast("bigint").alias("n_words"), n_hit(at).alias("n_hit"),
        F.size(at["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(at["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(at).alias("contaminated"), at["longest"].alias("longest_match"),
        at["longest_start"].alias("longest_start"), at["longest_item"].alias("longest_item"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    found, name = scanned(docs, benchmark, text, **names)
    return found.where(~contaminated(F.col(name))).drop(name)
