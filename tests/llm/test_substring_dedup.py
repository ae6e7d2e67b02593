"""Removed sentences against a plain walk over the documents in order of id."""

from __future__ import annotations

import random

from spanmill.llm import substring_dedup as sd

SCHEMA = "doc_id bigint, text string, hash string, n_removed string"


def plain(docs: list[tuple]) -> dict:
    """Kept texts by id, for unique ids."""
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        parts = sd.sentences(text or "")
        words = [sd.words_of(p) for p in parts]
        covered = set()
        spans = [
            (a, b) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1) if sum(map(len, words[a:b])) >= sd.WORDS
        ] if len(parts) < 100 else [(a, a + 13) for a in range(len(parts) - 12)]
        shortest = {(a, min(b for x, b in spans if x == a)) for a, _ in spans} | {(max(a for a, y in spans if y == b), b) for _, b in spans}
        for a, b in sorted(shortest):
            run = tuple(w for own in words[a:b] for w in own)
            if run in seen:
                covered |= set(range(a, b))
            seen.add(run)
        out[doc_id] = ("".join(p for k, p in enumerate(parts) if k not in covered), len(parts), len(covered))
    return out


def made() -> list[tuple]:
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]

    def sentence() -> str:
        return " ".join(draw.choices(vocabulary, k=draw.randrange(1, 9))) + draw.choice([". ", ".\n", "! ", "?\n\n", " .. "])

    passage = "".join(sentence() for _ in range(9))
    docs = []
    for k in range(80):
        parts = [sentence() for _ in range(draw.randrange(12))]
        if draw.random() < 0.5:
            parts.insert(draw.randrange(len(parts) + 1), passage)
        docs.append((k, "".join(parts)))
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "no end at all " * 5), (107, "no end at all " * 7 + ". B."), (108, "A. " + "no end at all " * 7 + "."), (104, "Go on. " * 5000), (105, docs[5][1]), (106, passage + passage), (None, passage)]
    return docs


def test_against_plain_walk(spark):
    docs = made()
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(5)
    rows = sd.deduplicated(frame).collect()
    found = {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in rows}
    assert len(rows) == len(docs) and found == plain(docs)
    assert found[108][2] == 1 and found[106][2] > 9 and found[None][0] == ""


def test_sentences_joined_are_the_text():
    for _, text in made():
        assert "".join(sd.sentences(text or "")) == (text or "")


def test_a_passage_goes_whole_whatever_its_sentences(spark):
    draw = random.Random(2)
    long = lambda n: " ".join(f"x{draw.randrange(10**6)}" for _ in range(n)) + ". "
    docs = []
    for k, sizes in enumerate([(30, 24), (24, 30), (16, 2, 5, 27, 24), (1, 60, 1), (51,), (5,) * 11, (24, 2, 26), (3, 24, 24, 3)]):
        passage = "".join(long(n) for n in sizes)
        docs += [(2 * k, long(9) + passage + long(7)), (2 * k + 1, long(8) + long(40) + passage + long(3))]
    found = {r["doc_id"]: r for r in sd.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for k, text in docs:
        parts = sd.sentences(text)
        assert found[k]["text"] == (text if k % 2 == 0 else "".join([*parts[:2], parts[-1]]))
    short = [(1, "a b c d e f. g h i j k l m. " + long(30)), (2, "a b c d e f. g h i j k l m. " + long(30))]
    assert all(r["n_removed"] == 0 for r in sd.deduplicated(spark.createDataFrame(short, "doc_id bigint, text string")).collect())


def test_rows_of_one_id_are_one_document(spark):
    text = "One two three four five six. " * 2 + "Seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen. End of it."
    frame = spark.createDataFrame([(4, text, "", ""), (4, text, "", ""), (9, text, "", "")], SCHEMA)
    assert sorted((r["doc_id"], r["n_removed"]) for r in sd.deduplicated(frame).collect()) == [(4, 0), (4, 0), (9, 4)]
    assert sd.deduplicated(frame.limit(0)).count() == 0
