"""Byte-level BPE encoding and decoding by replaying merges over a corpus.

The distinct pretokens of a slice of documents are a small corpus, encoded together. An inverted index leads from a merge
to all places of the corpus where it applies; merges are taken in rank order, each one at all its places at once, and only
the symbols beside these places are looked at again. What they form is entered into the index.

A pretoken must come out as if merged by itself, always at its lowest rank, leftmost first. That holds as long as what a
merge forms is merged later. A vocabulary may have tokens of which this is not true; their merges are applied at one place
of each pretoken at a time, and what they form goes first if its rank is lower.

Ids of a document are gathered from its pretokens, and its text is decoded from these ids. Nothing is shuffled.

Defined cases: a null text counts as empty and has no ids. Bytes that are not UTF-8 are U+FFFD. A text of one very long
pretoken is merged by the same index. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import batched, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_texts, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text of the documents that are encoded together.
SLICE_BYTES = 6 << 20
#: Pretokens of a text that are held at once.
PIECES = 1 << 16


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """The pairs of tokens that may be merged, in a table to look up many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = 1 + max(ranks.values())
        pairs = [
            (ranks[token[:k]] * self.size + ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.ranks = table[:, 0].copy(), table[:, 1].astype(np.int32)
        # Tokens that, once formed, can be merged at a lower rank than their own.
        self.early = np.zeros(self.size, dtype=bool)
        for part in (self.pairs // self.size, self.pairs % self.size):
            self.early[part[self.ranks < part]] = True
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32) if len(ranks) >= 256 else None
        self.single = {token[0]: rank for token, rank in ranks.items() if len(token) == 1}
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, tables: dict) -> Merges:
        """The same from the tables of another, which are plain data."""
        merges = cls.__new__(cls)
        vars(merges).update(tables)
        return merges

    def symbols(self, content: bytes) -> np.ndarray:
        raw = np.frombuffer(content, dtype=np.uint8)
        if self.byte is not None:
            return self.byte[raw]
        return np.array([self.single[b] for b in content], dtype=np.int32)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair is merged, -1 if it is not."""
        if not len(self.pairs):
            return np.full(len(a), -1, dtype=np.int32)
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], -1).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.starts[ids], self.lengths[ids])].tobytes()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + length - 1`` of each stretch, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def replay(pretokens: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pretokens, one after the other, and how many each has."""
    sizes = np.array([len(w) for w in pretokens], dtype=np.int64)
    symbol = merges.symbols(b"".join(pretokens))
    n = len(symbol)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(sizes)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    wanted = np.full(n, -1, dtype=np.int32)
    alive = np.ones(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Look up what each place and the one after it form, and note it in the index."""
        following = after[places]
        ranks = np.where(following >= 0, merges.merged(symbol[places], symbol[following]), -1)
        wanted[places] = ranks
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        by_rank = np.argsort(ranks, kind="stable")
        places, ranks = places[by_rank], ranks[by_rank]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    heappush(order, rank)
                index[rank].append(places[a:b])

    enter(np.arange(n))
    heapify(order)
    while order:
        rank = heappop(order)
        found = index.pop(rank)
        places = found[0] if len(found) == 1 else np.concatenate(found)
        places = np.unique(places[wanted[places] == rank])
        if not len(places):
            continue
        if merges.early[rank]:
            first = np.ones(len(places), dtype=bool)
            first[1:] = word[places[1:]] != word[places[:-1]]
            if not first.all():
                index[rank] = [places[~first]]
                heappush(order, rank)
            places = places[first]
        else:
            # Of places that overlap, as in a run of one letter, every second one goes.
            back = before[places]
            overlapping = (back >= 0) & (wanted[back] == rank)
            if overlapping.any():
                keep = ~overlapping
                for k in np.flatnonzero(overlapping).tolist():
                    keep[k] = not keep[k - 1]
                places = places[keep]
        gone = after[places]
        symbol[places] = rank
        wanted[gone] = -1
        alive[gone] = False
        next_ones = after[gone]
        after[places] = next_ones
        inner = next_ones >= 0
        before[next_ones[inner]] = places[inner]
        back = before[places]
        enter(np.concatenate([places, back[back >= 0]]))
    return symbol[alive], np.bincount(word[alive], minlength=len(sizes))


class Encoder:
    """Encodes slices of texts."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.pattern = regex.compile(pattern)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pretokens of a text, so many at a time."""
        if len(text) <= 4 * PIECES:
            yield self.pattern.findall(text)
        else:
            yield from map(list, batched((m.group() for m in self.pattern.finditer(text)), PIECES))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text its ids, and the same written in decimal, each preceded by a space."""
        number: dict[str, int] = defaultdict(lambda: len(number))
        used = [np.fromiter(map(number.__getitem__, chain.from_iterable(self.pieces(t))), dtype=np.int32) for t in texts]
        ids, counts = replay([w.encode() for w in number], self.merges)
        starts = np.cumsum(counts) - counts
        decimal = list(map(str, ids.tolist()))
        bounds = [*starts.tolist(), len(ids)]
        written = [" " + " ".join(decimal[a:b]) for a, b in zip(bounds, bounds[1:])]
        for own in used:
            yield ids[spread(starts[own], counts[own])], "".join(map(written.__getitem__, own.tolist()))


def encoded(
    docs: DataFrame, keys: list[Column], schema: str, text: str = "text", path: str | None = None, pattern: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """``keys`` (as ``schema`` names them), n_tokens, digests of ids and decoded bytes, and the ids where asked for."""
    merges = Merges(ranks_of(path or public_tokenizers.path(VOCABULARY)))
    shared = docs.sparkSession.sparkContext.broadcast((vars(merges), pattern or public_tokenizers.PATTERN))

    def start():
        tables, expression = shared.value
        encoder = Encoder(Merges.of(tables), expression)

        def work(texts: pa.Array, *kept: pa.Array) -> list:
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for ids, decimal in encoder.encode(texts.to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal[1:].encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(encoder.merges.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            return [*kept, counts, ids_sha, decoded_sha, *([all_ids] if with_ids else [])]

        return work

    made = f"{schema}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs, [text_of(text), *keys], made, start, text=0, limit=SLICE_BYTES)
