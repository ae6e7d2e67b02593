"""Formatted conversations read back, against digests taken from the turns themselves."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from spanmill.llm import chat_format

SCHEMA = "conv_id bigint, turn int, role string, text string, loss string, segments string"


def turns() -> list[tuple]:
    odd = ["", None, "\\", "\\\\", "###", "####", "#", "</turn>", "</turn", "\\### Assistant: </turn> ok", "### User: x</turn>\n", "a\nb\n", "é🙂", "x" * 200_000]
    odd += [f"{'#' * n} Assistant: hi" for n in range(3, 10)] + ["</</turn></turn>", "\\" * 3 + "###", "<" * 3 + "/turn>\n", "</turn" * 2, "#/" * 5]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(odd)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a")]
    rows += [(3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 0, "tool: </turn>\\", "t"), (3, None, None, "n"), (3, 7, "User", "cap")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, 0, "user", "q")]
    return [(*r, "clash", "clash") for r in rows]


def key(v: object) -> tuple:
    return (v is not None, v if v is not None else 0)


def test_read_back(spark):
    rows = turns()
    frame = spark.createDataFrame(rows, SCHEMA)
    formatted = chat_format.segments(frame)
    found = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    groups: dict = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((key(turn), role or "", text or ""))
    assert set(found) == set(groups)
    for conv, own in groups.items():
        own.sort(key=lambda t: (t[0], t[1]))
        r = found[conv]
        assert r["n_turns"] == len(own)
        spelled = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: found[c]["valid_order"] for c in found} == {1: True, 2: True, 3: False, None: True, 4: False}
    chars = {r["conv_id"]: r["n"] for r in formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert chars == {c: found[c]["formatted_chars"] for c in found}


def test_marks_stand_only_where_turns_begin_and_end(spark):
    formatted = chat_format.segments(spark.createDataFrame(turns(), SCHEMA)).collect()
    bodies = [r["text"] for k, r in enumerate(formatted) if k % 3 == 1]
    assert not any("###" in b or "</turn>" in b for b in bodies)
    whole = "".join(r["text"] for r in formatted if r["conv_id"] == 1)
    assert whole.count("###") == whole.count("</turn>") == len({r["turn_no"] for r in formatted if r["conv_id"] == 1})
    assert all(r["text"] == "</turn>\n" and not r["loss"] for r in formatted[2::3])


def test_empty_table_and_small_batches(spark):
    frame = spark.createDataFrame(turns(), SCHEMA)
    assert chat_format.read_back(chat_format.segments(frame.limit(0))).count() == 0
    whole = sorted(map(repr, chat_format.read_back(chat_format.segments(frame)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(map(repr, chat_format.read_back(chat_format.segments(frame)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
