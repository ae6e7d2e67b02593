"""Totals after any sequence of batches against counts of what is there, and commits that happen once."""

from __future__ import annotations

import random

import pytest

from spanmill.llm import token_counts as tc


def frame(spark, rows):
    return spark.createDataFrame(rows, tc.CHANGES)


def table(rollup) -> set:
    return {tuple(r) for r in rollup.totals().collect()}


def totals(state: dict) -> set:
    sums: dict = {}
    for (_, tokenizer), (source, lang, n) in state.items():
        d, t = sums.get((source, lang, tokenizer), (0, 0))
        sums[source, lang, tokenizer] = (d + 1, t + n)
    return {(*k, *v) for k, v in sums.items()}


def test_random_batches_and_repeated_commits(spark, tmp_path):
    draw = random.Random(6)
    rollup, state = tc.Rollup(spark, f"{tmp_path}/r"), {}
    for batch in (5, 1, 9, 2):
        rows = []
        for seq in range(60):
            op = draw.choice(["insert", "delete", "revise"])
            rows.append((seq, op, draw.choice([None, *range(25)]), draw.choice(["s", None]), draw.choice(["en", "fr"]), draw.choice(["v1", "v2"]), draw.choice([None, 3, 7])))
        changes = frame(spark, rows)
        assert rollup.commit(batch, changes) and not rollup.commit(batch, changes)
        last = {(r[2], r[5]): r for r in rows}
        for key, (_, op, _, source, lang, _, n) in last.items():
            if op == "delete":
                state.pop(key, None)
            else:
                state[key] = (source, lang, n or 0)
        assert table(rollup) == totals(state)
    assert not tc.Rollup(spark, f"{tmp_path}/r").commit(9, frame(spark, []))


def test_failed_batch_is_not_counted(spark, tmp_path, monkeypatch):
    rollup = tc.Rollup(spark, f"{tmp_path}/r")
    rollup.commit(1, frame(spark, [(1, "insert", 1, "s", "en", "v", 4)]))
    with monkeypatch.context() as m:
        m.setattr(rollup, "_sums", None)
        with pytest.raises(TypeError):
            rollup.commit(2, frame(spark, [(1, "insert", 2, "s", "en", "v", 5)]))
    assert table(rollup) == {("s", "en", "v", 1, 4)}
    assert rollup.commit(2, frame(spark, [(1, "insert", 2, "s", "en", "v", 6)]))
    assert table(rollup) == {("s", "en", "v", 2, 10)}


def test_empty_and_ties(spark, tmp_path):
    rollup = tc.Rollup(spark, f"{tmp_path}/r")
    assert table(rollup) == set()
    assert rollup.commit(1, frame(spark, []))
    same = [(1, "insert", 1, "s", "en", "v", n) for n in (4, 9, 4)]
    assert rollup.commit(2, frame(spark, same)) and table(rollup) == {("s", "en", "v", 1, 9)}


def test_counts_of_texts(spark):
    docs = spark.createDataFrame([(1, None, "s", "en", "c"), (2, "", "s", "en", "c"), (3, "Ünï 12, a-b\n!!", "s", "en", "c")], "doc_id bigint, text string, source string, lang string, n_tokens string")
    got = {(r["doc_id"], r["tokenizer"]): r["n_tokens"] for r in tc.counted(docs, "insert", 1).collect()}
    assert got == {(1, "words-1"): 0, (1, "pieces-1"): 0, (2, "words-1"): 0, (2, "pieces-1"): 0, (3, "words-1"): 4, (3, "pieces-1"): 8}
