"""Held-out accuracy on whole tables, and the defined cases."""

from __future__ import annotations

import random
import string
import zlib

from pyspark.sql import functions as F

from spanmill.llm import language_id as li
from spanmill.llm.catalog import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, lang_pred string, score string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = QUERIES["op6_language_id"](spark, sf)
    assert found.count() == docs.count()
    assert found.where("score < 0 or score > 1 or lang_pred is null").count() == 0
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("doc_id", "lang", "lang_pred").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows) > 1000


def test_defined_cases(spark):
    rows = [(k, f"the quick brown fox and the lazy dog number {chr(97 + k)} went home with them", "en") for k in range(20)]
    rows += [(k, f"der schnelle braune Fuchs und der faule Hund Nummer {chr(77 + k)} gingen nach Hause", "de") for k in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 -- ???", None), (53, "the dog went home with them", None), (54, "漢字", None), (55, "the fox " * 100_000, None)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    learned = li.learned(docs)
    assert set(learned) == {"de", "en"}
    got = {r["doc_id"]: r for r in li.predict(docs, learned, [F.col("doc_id")], "doc_id bigint").collect()}
    assert len(got) == len(rows)
    assert [got[k]["lang_pred"] for k in (50, 51, 52)] == [li.UNKNOWN] * 3 and [got[k]["score"] for k in (50, 51, 52)] == [0, 0, 0]
    assert got[53]["lang_pred"] == "en" and got[55]["lang_pred"] == "en" and got[54]["lang_pred"] in learned
    kept = li.accepted(docs, learned)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {53, 55} | set(range(40)) <= ids and not {50, 51, 52} & ids


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None, "", ""), (2, None, "en", "", "")], SCHEMA)
    assert li.learned(docs) == {}
    assert [r["lang_pred"] for r in li.predict(docs, {}, [F.col("doc_id")], "doc_id bigint").collect()] == [li.UNKNOWN] * 2
    assert li.accepted(docs, {}).count() == 0
    assert li.predict(docs.limit(0), {"en": b" a "}, [F.col("doc_id")], "doc_id bigint").count() == 0


def test_sample_is_bounded_and_by_text(spark):
    rows = [(k, f"word{k % 50} and more", "en", "", "") for k in range(400)]
    few = li.Parameters(samples=7, sample_chars=9)
    made = li.fit(spark.createDataFrame(rows, SCHEMA), p=few)
    assert len(made["en"]) <= 7 * 11
    assert made == li.fit(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), p=few)


def test_length_does_not_enter_the_margin():
    draw = random.Random(3)
    vocabulary = {name: ["".join(draw.choices(string.ascii_lowercase, k=draw.randrange(3, 9))) for _ in range(3000)] for name in ("aa", "bb")}

    def some(name: str, n: int) -> bytes:
        return li.letters(" ".join(draw.choices(vocabulary[name], k=n)).encode())

    by_name = li.compressors({name: some(name, 16_000) for name in vocabulary})
    for name in vocabulary:
        found = [li.classify(some(name, n), by_name) for n in (2_000, 20_000, 600_000)]  # up to 4 MB
        assert [f[0] for f in found] == [name] * 3
        assert min(f[1] for f in found) > 0.8 * max(f[1] for f in found) > 0.1
        words = [li.classify(f" {w} ".encode(), by_name) for w in vocabulary[name][:50]]
        assert sum(f[0] == name and f[1] >= li.Parameters().min_margin for f in words) >= 45
    assert li.classify("漢".encode(), by_name) == ("aa", 0.0)
