"""Ids against the tiktoken library, and the round trip."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spanmill.llm import byte_bpe

TEXTS = [
    None, "", " ", "\n\n \t", "Hello world", "it's  they'LL 12345 1 23", "<|endoftext|> is text", "naïve café – ✓ 漢字 🙂🙃", "a" * 3000,
    "ab" * 2000 + "\r\n" + "é" * 500, "   leading", "trailing   ", "x\u0000y", "  z", "Hello world",
]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.ranks_of(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_the_library_and_comes_back(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    found = byte_bpe.encoded(docs, [F.col("doc_id")], "doc_id bigint").collect()
    assert len(found) == len(TEXTS)
    for r in found:
        text = TEXTS[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encoded(docs.limit(0), [F.col("doc_id")], "doc_id bigint").count() == 0


def test_cutting_texts_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    merges = byte_bpe.Merges(byte_bpe.ranks_of(public_tokenizers.path(byte_bpe.VOCABULARY)))
    texts = [t or "" for t in TEXTS] * 2
    for text, (ids, decimal) in zip(texts, byte_bpe.Encoder(merges, public_tokenizers.PATTERN).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert decimal == "".join(f" {i}" for i in ids) and merges.decode(ids) == text.encode()


def test_made_up_ranks_whose_merges_do_not_grow():
    """A merge may give rise to one of lower rank; each word must be as if merged alone."""
    draw = random.Random(3)
    early = 0
    for _ in range(300):
        tokens = {bytes([c]) for c in b"abc"}
        while len(tokens) < 14:
            tokens.add(bytes(draw.choices(b"abc", k=draw.randint(2, 5))))
        single = sorted(t for t in tokens if len(t) == 1)
        rest = sorted(t for t in tokens if len(t) > 1)
        draw.shuffle(rest)
        ranks = {t: k for k, t in enumerate(single + rest)}
        words = [bytes(draw.choices(b"abc", k=draw.randint(0, 12))) for _ in range(30)]
        merges = byte_bpe.Merges(ranks)
        early += merges.early.any()
        ids, counts = byte_bpe.replay(words, merges)
        assert counts.sum() == len(ids)
        ends = counts.cumsum()
        for word, end, n in zip(words, ends, counts, strict=True):
            parts = [word[k : k + 1] for k in range(len(word))]
            while True:
                pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert ids[end - n : end].tolist() == [ranks[p] for p in parts]
    assert early > 100


def test_query_round_trip(spark, library):
    from spanmill.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
