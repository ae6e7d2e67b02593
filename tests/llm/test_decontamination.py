"""Hits, items and longest matches against plain comparison of windows, one block and many."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from spanmill.llm import decontamination as dc

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, items string, found string"


def words(text: str | None) -> list[str]:
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text: str | None, items: list[tuple]) -> tuple:
    mine, hit, names, longest = words(text), set(), set(), 0
    for name, item in items:
        own = words(item)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for at in range(len(mine) - n + 1):
                if mine[at : at + n] == own[k : k + n]:
                    hit |= set(range(at, at + n))
                    names.add("null" if name is None else str(name))
                    size = n
                    while at + size < len(mine) and k + size < len(own) and mine[at + size] == own[k + size]:
                        size += 1
                    longest = max(longest, size)
    sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(mine), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(mine), longest


def made(draw: random.Random) -> tuple[list, list]:
    vocabulary = ["a", "b", "c1", "É", "ñx", "Zed"]

    def some(n: int) -> str:
        return draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, k=n))

    items = [(k, some(draw.choice([1, 5, 12, 13, 14, 30]))) for k in range(12)]
    items += [(3, some(20)), (None, some(16)), (90, ""), (91, None), (92, "?!"), (10, items[10][1]), (93, "zz " * 40)]
    docs = []
    for k in range(60):
        text = some(draw.choice([0, 3, 40, 300]))
        for _ in range(draw.randrange(3)):
            own = words(draw.choice(items)[1])
            a, b = sorted((draw.randrange(len(own) + 1), draw.randrange(len(own) + 1)))
            text += " " + " ".join(own[a:b]).upper() + " " + some(4)
        docs.append((k, text, "x", "y"))
    docs += [(100, None, "", ""), (101, "", "", ""), (102, "zz " * 5000, "", ""), (7, docs[7][1], "", ""), (103, "\u0000 \x7f~", "", "")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 120])
def test_against_plain_comparison(spark, block_bytes, monkeypatch):
    docs, items = made(random.Random(11))
    frame = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = dc.report(frame, bench, block_bytes=block_bytes).collect()
    found = sorted((r["doc_id"], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["longest_match"])) for r in rows)
    assert found == sorted((d[0], plain(d[1], items)) for d in docs)
    kept = dc.clean(frame, bench, block_bytes=block_bytes)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d[0] for d in docs if not plain(d[1], items)[4])


def test_repeated_rows_are_one_item(spark):
    bench = spark.createDataFrame([(1, "some words " * 9)] * 50 + [(2, "some words " * 9), (3, "others")], "item_id bigint, text string")
    assert sorted(len(b) for b in dc.blocks(bench, "item_id", "text", 10**6)) == [3]
    assert max(len(b) for b in dc.blocks(bench, "item_id", "text", 100)) <= 3


def test_a_passage_of_many_items_and_documents_is_found_once():
    passage = " ".join(f"p{k}" for k in range(40))
    items = [(f"i{k}", f"{passage} t{k} u{k}".encode()) for k in range(60)]
    texts = [f"a{k} b{k} {passage} t{k} z".encode() for k in range(30)]
    windows = dc.Windows(items)
    numbers = [[windows.vocabulary.get(w, 0) for w in dc.words(t)] for t in texts]
    which, _ = windows.search(np.concatenate(numbers), np.cumsum([len(n) for n in numbers]))
    assert len(which) == 30 * (28 + 1)
    names = sorted(name for name, _ in items)
    assert windows.find(texts) == [(44, [2, 43], names, (41, 2, f"i{k}")) for k in range(30)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_words"], r["n_hit"]) for r in dc.report(docs, none).collect()] == [(2, 0)]
    assert dc.report(docs.limit(0), none).count() == 0
