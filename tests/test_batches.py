"""Large batches go through in parts, and the parts give what the whole gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmill.functions import batches as B
from spanmill.functions import decode, encode
from spanmill.functions import sequences as Q
from spanmill.operators import corpus as K
from spanmill.operators import corruption as Z
from spanmill.operators import packing as P
from spanmill.operators import vocabulary_use as V
from spanmill.functions import spans as S


def bounded(fn, size):
    """``fn``, which refuses arrays that hold much more than is worked on at a time."""

    def checked(arrays, *rest):
        assert size(arrays) <= B.AT_ONCE, "a whole batch at once"
        return fn(arrays, *rest)

    return checked


def texts(spark, rows=3000):
    text = F.when(F.col("id") % 7 > 0, F.concat(F.repeat(F.lit("가a</s>é "), 200), F.col("id").cast("string")))
    return spark.range(0, rows, 1, 1).select("id", text.alias("text"))


def test_runs_hold_every_row_once():
    sizes = np.array([0, 3, 9, 0, 0, 2, 2, 2, 50, 0])
    assert list(B.runs(sizes, 6)) == [(0, 2), (2, 1), (3, 5), (8, 1), (9, 1)]
    assert list(B.runs(np.array([], np.int64), 6)) == []
    parts = list(B.text_parts(pa.array(["ab", None, "é", "xyz"]).slice(1), 3))
    assert [p.to_pylist() for p in parts] == [[None, "é"], ["xyz"]]


def test_syllables_across_a_border_of_the_parts(monkeypatch):
    raw = np.frombuffer("a가힣é나".encode(), np.uint8)
    whole = encode.letter_values(raw)
    for at_once in (1, 2, 3, 5):
        monkeypatch.setattr(encode, "AT_ONCE", at_once)
        assert encode.letter_values(raw).tolist() == whole.tolist()


@pytest.mark.parametrize("name", ["letter_ids", "special_letter_ids"])
def test_ids_are_made_in_parts(spark, monkeypatch, name):
    inner = {"letter_ids": "letters_of_batch", "special_letter_ids": "special_letters_of_batch"}[name]
    size = lambda a: sum(len(t.encode()) for t in a.to_pylist() if t is not None)
    plain = getattr(encode, f"{name}_expr")
    few = texts(spark, 20).select("id", getattr(encode, name)("text").alias("ids"), plain("text").alias("expected"))
    assert few.where("NOT ids <=> expected").count() == 0
    monkeypatch.setattr(encode, inner, bounded(getattr(encode, inner), size))
    made = texts(spark).select("id", getattr(encode, name)("text").alias("ids"))
    assert made.agg(F.count("ids")).first()[0] == sum(k % 7 > 0 for k in range(3000))


def test_vocabulary_is_counted_in_parts(spark, monkeypatch):
    size = lambda a: sum(len(t.encode()) for t in a.to_pylist() if t is not None)
    monkeypatch.setattr(V, "special_letters_of_batch", bounded(V.special_letters_of_batch, size))
    used = V.vocabulary_use(texts(spark)).where("token = '</s>'").first()["n"]
    assert used == 200 * sum(k % 7 > 0 for k in range(3000))


def test_ids_are_read_and_corrupted_in_parts(spark, monkeypatch):
    size = lambda a: len(a.flatten())
    monkeypatch.setattr(decode, "_text_of_batch", bounded(decode._text_of_batch, size))
    docs = texts(spark)
    back = docs.select("id", "text", decode.decode_ids(encode.letter_ids("text")).alias("back"))
    assert back.where("NOT text <=> back").count() == 0
    monkeypatch.setattr(Z, "corrupted_batch", bounded(Z.corrupted_batch, size))
    pieces = K.split_segments(docs.select("id", encode.letter_ids("text").alias("ids")), "ids", 1000, ["id"])
    assert Z.corrupt(pieces, ["id", "segment"], S.LETTERS_ASCENDING).count() == pieces.count()


def test_segments_are_cut_without_a_lambda(spark):
    rows = [(1, None), (2, []), (3, [5]), (4, list(range(7))), (None, list(range(6))), (4, list(range(7)))]
    df = spark.createDataFrame(rows, "id bigint, ids array<int>").coalesce(1)
    found = K.split_segments(df, "ids", 3, ["id"])
    assert dict(found.dtypes) == {"id": "bigint", "segment": "int", "ids": "array<int>"}
    seven = [(4, 0, [0, 1, 2]), (4, 1, [3, 4, 5]), (4, 2, [6])]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(3, 0, [5]), *seven, *seven, (None, 0, [0, 1, 2]), (None, 1, [3, 4, 5])], key=str)
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # a lambda would copy the whole text for each piece


def test_groups_are_joined_one_at_a_time(spark):
    rows = [(3, [4]), (0, [1, 2]), (1, []), (2, [3]), (2, [2, 9]), (5, [7]), (None, [8]), (None, [6, 1]), (4, None)]
    joined = K.concat_tokens(spark.createDataFrame(rows, "n bigint, ids array<int>"), "ids", "n", group_size=4)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(
        [(0, 4, [1, 2, 2, 9, 3, 4]), (1, 1, [7]), (None, 2, [6, 1, 8])], key=str
    )
    plan = joined._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan


def test_ids_meet_compressed(spark):
    texts = [(0, "abc 가나다" * 30), (1, ""), (2, None), (3, "라" * 40), (3, "z"), (3, "라" * 39), (5, "é"), (None, "b"), (None, "a"), (6, "한글" * 70)]
    df = spark.createDataFrame(texts, "n bigint, text string")
    lists, small = df.select("n", encode.letter_ids("text").alias("ids")), df.select("n", encode.letter_ids("text", squeeze=True).alias("ids"))
    joined = lambda ids: K.concat_tokens(ids, "ids", "n", group_size=4, chunk_length=100)
    found = joined(small)
    assert dict(found.dtypes) == {"group_id": "bigint", "records": "int", "ids": "binary"}
    rows = lambda df: sorted(map(tuple, Q.with_lists(df).collect()), key=str)
    assert rows(found) == rows(joined(lists)) and [r[1] for r in rows(found)] == [4, 2, 2]
    held = [r["ids"] for r in small.where("n < 3").collect()]
    whole = B.packed(pa.array([lists.where("n = 0").first()["ids"]], pa.list_(pa.int32())))[0].as_py()
    assert B.unsqueezed(held[0]) == whole and len(held[0]) < len(whole) / 5 and B.unsqueezed(held[1]) == b"" and held[2] is None


def test_ids_become_text_and_rows_of_one_width_by_the_batch(spark):
    rows = [(1, [5, 6, 300, 8], [1]), (2, None, []), (None, [], [2, -100]), (4, [9], None), (4, [3, None], [384])]
    df = spark.createDataFrame(rows, "id bigint, a array<int>, b array<int>").coalesce(1)
    spelled = Q.spelled(df, ["a", "b"])
    assert dict(spelled.dtypes) == {"id": "bigint", "a": "string", "b": "string"}
    expected = df.select("id", Q.ids_text(F.col("a")).alias("a"), Q.ids_text(F.col("b")).alias("b"))
    assert spelled.collect() == expected.collect()
    whole = df.where("id is null or id < 4")
    padded = P.pad_examples(whole, ["id"], {"a": 3, "b": 2})
    assert padded.collect() == [(1, [5, 6, 1], [1, 0]), (2, None, [0, 0]), (None, [0, 0, 0], [2, -100])]
    assert [r["a"] for r in P.pad_examples(whole, ["id"], {"a": 3}, ensure_eos=False).collect()] == [[5, 6, 300], None, [0, 0, 0]]
    for made in (spelled, padded):
        assert "MapInArrow" in made._jdf.queryExecution().toString()  # and no step for each id


def test_packed_ids_are_the_same_lists_and_sort_alike():
    lists = pa.array([[5, 384, 1], None, [], [65535, 0], [5, 1]], pa.list_(pa.int32()))
    raw = B.packed(lists)
    assert B.as_lists(raw).to_pylist() == lists.to_pylist() and B.as_lists(lists) is lists
    assert B.as_lists(raw.slice(1, 3)).to_pylist() == lists.slice(1, 3).to_pylist()
    assert B.packed(lists.slice(3)).to_pylist() == raw.slice(3).to_pylist() and B.as_lists(raw.slice(5)).to_pylist() == []
    assert B.list_sizes(raw).tolist() == B.list_sizes(lists).tolist() == [3, 0, 0, 2, 2]
    held = [k for k in range(5) if k != 1]
    assert sorted(held, key=lambda k: raw[k].as_py()) == sorted(held, key=lambda k: lists[k].as_py())


def test_spans_drawn_by_the_batch_are_those_of_the_expression(spark):
    rows = [(k, None if k % 7 == 0 else k % 3, n) for k, n in enumerate([None, 0, 1, 2, 3, 7, 20, 133, 400, 1137, 1192, 3000])]
    df = spark.createDataFrame(rows, "a bigint, b int, n int").select("a", "b", F.expr("transform(sequence(1, n), x -> x % 250)").alias("ids"))
    df = df.withColumn("ids", F.when(F.col("a") != 1, F.col("ids")).otherwise(F.array().cast("array<int>")))
    given = Z.corrupt(df, ["a", "b"], S.LETTERS_ASCENDING, seed=3, spans_step=lambda n, key: S.noise_spans(n, *key, seed=3))
    drawn = Z.corrupt(df, ["a", "b"], S.LETTERS_ASCENDING, seed=3)
    expected = sorted(map(tuple, given.collect()), key=str)
    assert sorted(map(tuple, drawn.collect()), key=str) == expected and len(expected) == 12
    plan = drawn._jdf.queryExecution().toString()
    assert "md5" not in plan  # one draw costs more there than a segment costs here
    small = Z.corrupt(df, ["a", "b"], S.LETTERS_ASCENDING, seed=3, pack=True)
    assert dict(small.dtypes)["inputs"] == "binary"
    assert sorted(map(tuple, Q.with_lists(small).collect()), key=str) == expected


def test_draws_of_a_batch_are_those_of_each_row():
    keys = [f":{37 * k}:{k}" for k in range(40)] + [":" + "é" * 22, ":" + "x" * 46, ":" + "y" * 200, ""]
    tokens = np.array([0, 1, 2, 3, 9, 10, 11, 99, 100, 101, 1000, 1193, *range(12, 40), 1193, 1193, 101, 2500])
    for density, mean_span, seed in ((0.15, 20.0, 1), (0.5, 3.0, 5), (0.9, 1.0, 2), (0.5, 1.0, 7)):
        found = S.spans_of_batch(tokens, keys, seed, density, mean_span).to_pylist()
        given = [S.drawn_spans(n, seed, key, density, mean_span) for n, key in zip(tokens.tolist(), keys, strict=True)]
        assert [None if row is None else [tuple(span.values()) for span in row] for row in found] == [row or None for row in given]


def test_steps_on_the_other_side_and_denser_noise_work_by_the_batch(spark):
    rows = [(k, None if k % 4 == 1 else k, n) for k, n in enumerate([None, 0, 1, 2, 3, 20, 400, 1193])]
    df = spark.createDataFrame(rows, "a bigint, b int, n int").select("a", "b", F.expr("transform(sequence(1, n), x -> x % 250)").alias("ids"))
    df = df.withColumn("ids", F.when(F.col("a") != 1, F.col("ids")).otherwise(F.array().cast("array<int>")))
    denser = S.NoiseSpans(seed=5, density=0.5, mean_span=3.0)
    spanned = df.withColumn("spans", S.noise_spans(F.size("ids"), F.col("a"), F.col("b"), seed=5, density=0.5, mean_span=3.0))
    by_hand = {"i": S.corrupt_inputs, "t": S.corrupt_targets}
    plain = lambda c, end: Q.append_eos_always(c) if end is None else Q.trim_then_eos(c, end)
    for sides, lengths in (("ti", None), ("ti", (9, 30)), ("ii", (9, 30)), ("it", None)):
        ends = lengths or (None, None)
        expected = spanned.select("a", "b", *[plain(by_hand[k](F.col("ids"), F.col("spans"), S.BYTES_ASCENDING), n) for k, n in zip(sides, ends)])
        for spans_step in (denser, lambda n, key: denser(n, key)):
            steps = {"inputs_step": by_hand[sides[0]], "targets_step": by_hand[sides[1]], "spans_step": spans_step}
            made = Z.corrupt(df, ["a", "b"], S.BYTES_ASCENDING, lengths=lengths, **steps)
            plan = made._jdf.queryExecution().toString()
            assert "MapInArrow" in plan and ("md5" in plan) == (spans_step is not denser)
            assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_packed_bytes_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(1, "a é 가"), (2, ""), (3, None), (4, "\x00\U0001f600" * 300)], "id bigint, text string")
    small = Q.with_lists(df.select("id", encode.byte_ids("text", pack=True).alias("ids")))
    assert sorted(small.collect()) == sorted(df.select("id", encode.byte_ids("text").alias("ids")).collect())


def test_packing_takes_packed_ids(spark):
    from spanmill.operators import length_packing as H

    docs = spark.range(0, 60, 1, 3).select((F.col("id") % 50).alias("id"), F.repeat(F.lit("가나 b"), (F.col("id") * 7 % 90).cast("int")).alias("text"))
    pairs = {}
    for pack in (False, True):
        cut = K.split_segments(docs.select("id", encode.letter_ids("text", pack).alias("ids")), "ids", 300, ["id"])
        pairs[pack] = Z.corrupt(cut, ["id", "segment"], S.LETTERS_ASCENDING, pack=pack)
    rows = lambda df: sorted(map(str, Q.with_lists(df).collect()))
    keys = ["id", "segment"]
    for made in (
        lambda df, **more: P.pack_examples(df, keys, F.floor(F.col("id") / 10), **more),
        lambda df, **more: P.pad_examples(df, keys, **more),
        lambda df, **more: H.pack_by_lengths(df, keys, **more),
        lambda df, **more: H.unpacked(H.pack_by_lengths(df, keys, **more), ["inputs", "targets"]),
    ):
        expected = rows(made(pairs[False]))
        small = made(pairs[True], packed_ids=True)
        assert dict(small.dtypes)["inputs"] == "binary" and rows(small) == expected
        assert dict(made(pairs[True]).dtypes)["inputs"] == "array<int>" and rows(made(pairs[True])) == expected
