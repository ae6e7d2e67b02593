"""Substring dedup: runs of consecutive sentences that occurred before are removed.

A text is cut into sentences, each with the white space around it, so the sentences of a text joined are the text. A run is
consecutive sentences of ``WORDS`` words or more together: from every sentence the shortest run that begins there, and to every
sentence the shortest run that ends there. So both ends of a repeated passage are reached, however long its sentences are. The
words of a run are hashed. Hashes meet globally; a run is a repeat if a document with a smaller id holds it, or the same
document holds it further up. Every sentence that a repeat covers is removed.

Only hashes and places are shuffled to find repeats: an aggregation with a sum before the shuffle, and a join in which a
passage that a third of all documents hold can be split by the adaptive plan. Texts move once, to meet their repeats.

Defined cases: a null text counts as empty; a text without sentences stays as it is. Rows with the same id count as one
document, so none of them loses what another has; a null id comes after all others. Repeats inside one document go, too.
Words are compared as written, white space as one space. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_texts, text_of
from spanmill.session import written

WORDS = 25
#: The white space and the ends of sentences.
SENTENCE = r"[ \t\r\n]*[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"
WHITE = " \t\r\n"
LAST_ID = (1 << 63) - 1


def sentences(text: str) -> list[str]:
    return re.findall(SENTENCE, text)


def words_of(sentence: str) -> list[str]:
    return re.split(f"[{WHITE}]+", sentence.strip(WHITE)) if sentence.strip(WHITE) else []


def runs(sizes: list[int]) -> list[tuple[int, int]]:
    """First sentence of every run and the one behind its last, from the words of each sentence."""
    before = [0, *accumulate(sizes)]
    found = set()
    for k in range(len(sizes)):
        end = bisect_left(before, before[k] + WORDS)
        if end < len(before):
            found.add((k, end))
        start = bisect_right(before, before[k + 1] - WORDS) - 1
        if start >= 0:
            found.add((start, k + 1))
    return sorted(found)


def run_hashes(text: str) -> Iterator[tuple[int, int, int]]:
    """``first sentence, sentences, hash`` of every run."""
    words = [words_of(s) for s in sentences(text)]
    spelled = [" ".join(w) for w in words]
    for start, end in runs([len(w) for w in words]):
        digest = xxhash.xxh3_64_intdigest(" ".join(spelled[start:end]).encode())
        yield start, end - start, digest - (1 << 63)


def hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, version, at, n, hash, again`` for every run; ``version`` is the hash of the whole text.

    ``again``: the run stands in the same text further up.
    """

    def start():
        def work(texts: pa.Array, ids: pa.Array, versions: pa.Array) -> list:
            of, at, n, hashes, again = [], [], [], [], []
            for k, t in enumerate(texts.to_pylist()):
                seen: set[int] = set()
                for a, b, h in run_hashes(t):
                    of.append(k)
                    at.append(a)
                    n.append(b)
                    hashes.append(h)
                    again.append(h in seen)
                    seen.add(h)
            rows = pa.array(of, pa.int64())
            return [ids.take(rows), versions.take(rows), at, n, hashes, again]

        return work

    inputs = [text_of(text), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST_ID)), F.xxhash64(text_of(text))]
    schema = "doc_id bigint, version bigint, at int, n int, hash bigint, again boolean"
    return map_texts(docs, inputs, schema, start, text=0)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, version, at, n`` of every run that is not the first of its kind."""
    found = written(hashed(docs, doc_id, text), "runs")
    across = found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    across = written(across.select("hash", "first"), "repeated")  # as a table, so that the join can split a hot hash
    later = found.join(across, "hash").where("doc_id > first")
    columns = ["doc_id", "version", "at", "n"]
    return later.select(*columns).union(found.where("again").select(*columns))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` for every document, with the text that stays."""
    at = F.collect_set(F.struct("at", "n")).alias("gone")  # twice as many as the text has sentences at most
    gone = repeats(docs, doc_id, text).groupBy("doc_id", "version").agg(at)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_of(text).alias("text"))
    rows = rows.select("*", F.coalesce("id", F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("version"))
    both = rows.join(gone, ["doc_id", "version"], "left").select(
        "id", "text", F.col("gone.at").alias("at"), F.col("gone.n").alias("n")
    )

    def start():
        def work(ids: pa.Array, texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> list:
            kept, total, removed = [], [], []
            for t, at, n in zip(texts.to_pylist(), starts.to_pylist(), lengths.to_pylist(), strict=True):
                parts = sentences(t)
                covered = {k for a, b in zip(at or [], n or [], strict=True) for k in range(a, a + b)}
                kept.append("".join(s for k, s in enumerate(parts) if k not in covered))
                total.append(len(parts))
                removed.append(len(covered))
            return [ids, kept, total, removed]

        return work

    inputs = [F.col(c) for c in ("id", "text", "at", "n")]
    return map_texts(both, inputs, "doc_id bigint, text string, n_sentences bigint, n_removed bigint", start)
