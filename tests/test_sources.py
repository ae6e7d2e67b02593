"""Readers, writers, streams and recipes."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from spanmill.functions import spans as S
from spanmill.functions.encode import byte_ids, letter_ids
from spanmill.operators.corruption import corrupt
from spanmill.operators import packing as Z
from spanmill.plans import jobs
from spanmill.plans.recipes import Recipe, Registry, registry, segmented
from spanmill.session import shared_dir
from spanmill.sources import readers as R
from spanmill.sources import sinks as W
from spanmill.streaming import jobs as T


def test_gzip_shards_are_numbered_in_file_order(spark, tmp_path):
    want = []
    for shard in (2, 0, 1):
        texts = [f"{shard}:{i} 가\n" for i in range(5 + shard)]
        with gzip.open(tmp_path / f"c.{shard:05}.json.gz", "wt", encoding="utf-8") as f:
            f.writelines(json.dumps({"url": "u", "text": t}, ensure_ascii=False) + "\n" for t in texts)
    for shard in range(3):
        want += [f"{shard}:{i} 가\n" for i in range(5 + shard)]
    got = R.read_jsonl_shards(spark, str(tmp_path / "c.*.json.gz")).orderBy("record_no").collect()
    assert [r["text"] for r in got] == want and [r["record_no"] for r in got] == list(range(len(want)))


def test_literal_lines(spark, tmp_path):
    path = tmp_path / "problems"
    path.write_text(
        """{'equation': 'x=1', 'original_text_kr': "it's", 'ans': 3}\n"""
        "bad\n\n"
        """{'equation': "x='None'", 'original_text_kr': 'a \\'None\\' "True" b', 'ans': None, 'ok': True}\n"""
        """{'equation': 'None', 'original_text_kr': 'False, None', 'ans': '1.50'}\n"""
    )
    rows = R.read_literal_lines(spark, str(path)).collect()
    assert [r.asDict() for r in rows] == [
        {"original_text_kr": "it's", "equation": "x=1", "ans": "3", "_corrupt_record": None},
        {"original_text_kr": None, "equation": None, "ans": None, "_corrupt_record": "bad"},
        {"original_text_kr": "a 'None' \"True\" b", "equation": "x='None'", "ans": None, "_corrupt_record": None},
        {"original_text_kr": "False, None", "equation": "None", "ans": "1.50", "_corrupt_record": None},
    ]


def test_tsv_round_trip(spark, tmp_path):
    awkward = [' a\tb"c\nd\\e ', "", None, '""', "plain", "\\", "한글"]
    df = spark.createDataFrame([("Solve", t, "1") for t in awkward], R.TRIPLE_SCHEMA)
    W.write_tsv(df, str(tmp_path / "t"))
    back = [r["input_text"] for r in R.read_tsv(spark, str(tmp_path / "t")).collect()]
    assert sorted(back) == sorted(t or "nan" for t in awkward)
    raw = R.read_tsv(spark, str(tmp_path / "t"), missing=None)
    assert raw.where("input_text is null").count() == 2


def test_named_splits_prune_folders(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 70, "ko").otherwise("en").alias("lang"), F.when(F.col("id") % 10 < 9, "train").otherwise("validation").alias("split"))
    W.write_named_splits(df, str(tmp_path / "c"))
    part = R.read_named_split(spark, str(tmp_path / "c"), "ko", "validation")
    assert sorted(r["id"] for r in part.collect()) == list(range(9, 70, 10))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_predictions_keep_their_order(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit("p\n"), "id").alias("v")).repartition(7)
    W.write_predictions(df, str(tmp_path / "p"), "id", "v", files=4)
    files = sorted(p for p in (tmp_path / "p").iterdir() if p.name.startswith("part-"))
    assert len(files) > 1
    assert "".join(p.read_text() for p in files).splitlines() == [f"p {i}" for i in range(500)]


def test_token_cache(spark, tmp_path):
    df = spark.range(5).select("id", byte_ids(F.col("id").cast("string")).alias("ids"))
    W.write_token_cache(df, str(tmp_path / "t"), "bytes", "train")
    W.write_token_cache(df.where("id > 3"), str(tmp_path / "t"), "bytes", "validation")
    assert R.spread(W.read_token_cache(spark, str(tmp_path / "t"), "bytes", "validation"), "id").collect() == df.where("id > 3").collect()


def test_the_shared_folder_is_the_one_named(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.fixture
def records(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, "가나 abc " * (i % 40)) for i in range(200)]
    spark.createDataFrame(rows[:120], "id int, text string").repartition(3).write.json(path)
    return path, rows


def test_streams_equal_batch_and_take_up_new_files(spark, tmp_path, records):
    path, rows = records
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = T.stream_table(spark, path, "id int, text string", "json", files_per_batch=1)
        T.run_to_parquet(T.stream_corrupt(stream, ["id"]), out, state)

    run()
    spark.createDataFrame(rows[120:], "id int, text string").write.mode("append").json(path)
    run()
    run()
    batch = T.stream_corrupt(spark.read.schema("id int, text string").json(path), ["id"])
    assert spark.read.parquet(out).orderBy("id").collect() == batch.orderBy("id").collect()
    assert batch.count() == sum(1 for r in rows if r[1])


def test_streamed_verdict_counts(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("x=1+1", "2")] * 5 + [("x=1+1", "3")] * 2 + [("x=", "3")]
    spark.createDataFrame(rows, "equation string, ans string").repartition(4).write.json(path)
    stream = T.stream_table(spark, path, "equation string, ans string", "json", files_per_batch=1)
    T.run_counts(T.verdict_counts(stream), out, state)
    assert {r["verdict"]: r["n"] for r in T.latest_counts(spark, out).collect()} == {"right": 5, "wrong": 2, "error": 1}


def test_registry(spark):
    own = Registry()
    own.add(Recipe("copy", (lambda df: df.withColumn("inputs", F.col("text")),), keys=("id",)))
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    assert own.recipe("copy").run(df).columns == ["id", "inputs"]
    with pytest.raises(ValueError):
        own.add(own.recipe("copy"))
    own.add_mixture("m", {"copy": 1.0})
    with pytest.raises(ValueError):
        own.add_mixture("m", {})
    with pytest.raises(ValueError):
        segmented(byte_ids, lengths=(1024, 100))


def test_recipe_equals_direct_call(spark):
    df = spark.range(300).select(F.col("id").alias("record_no"), F.repeat(F.lit("가a"), (F.col("id") % 9).cast("int")).alias("text"))
    from spanmill.operators.corpus import joined_segments

    segments = joined_segments(df, "text", "record_no", letter_ids, 1193)
    direct = corrupt(segments, ["group_id", "segment"], S.LETTERS_ASCENDING, lengths=(1024, 189))
    order = ["group_id", "segment"]
    assert registry.recipe("letters_ascending").run(df).orderBy(*order).collect() == direct.orderBy(*order).collect()


def test_sentinel_schemes_agree_but_for_the_sentinels(spark):
    df = spark.range(50).select(F.col("id").alias("record_no"), F.repeat(F.lit("abc "), 90).alias("text"))
    up = registry.recipe("bytes_ascending").run(df).orderBy("group_id", "segment").collect()
    down = registry.recipe("bytes_descending").run(df).orderBy("group_id", "segment").collect()
    assert [[517 - x if x > 258 else x for x in r["inputs"]] for r in up] == [r["inputs"] for r in down]


def test_equation_corpus(spark):
    df = spark.createDataFrame(
        [("q1", "x=50%*4", "2"), ("q2", "x=1+1", "3"), ("q3", "x=y", "1")], "original_text_kr string, equation string, ans string"
    )
    assert [tuple(r) for r in jobs.equation_corpus(df).collect()] == [("Solve", "q1", "50%*4")]


def test_labelled_text(spark):
    df = spark.createDataFrame([(1, " good.. ", 1), (2, "a" * 600, 0)], "id int, text string, label int")
    good, long = jobs.labelled_text(df).orderBy("id").collect()
    assert good["source_ids"] == [106, 114, 114, 103, 1] + [0] * 507 and sum(good["source_mask"]) == 5
    assert good["target_ids"] == [b + 3 for b in b"positive"] + [1, 0]
    assert good["labels"][-2:] == [1, -100] and good["target_mask"] == [1] * 9 + [0]
    assert len(long["source_ids"]) == 512 and long["source_ids"][-1] == 1 and sum(long["source_mask"]) == 512


def test_eval_holdout(spark):
    df = spark.range(450).select(F.col("id").alias("record_no"), F.lit("한글 text " * 300).alias("text"))
    rows = jobs.eval_holdout(df).collect()
    assert sorted(r["record_no"] for r in rows) == [99, 199, 299, 399]
    assert all(len(r["inputs"]) == 1024 and len(r["targets"]) == 189 for r in rows)


def corpus(spark):
    text = F.concat(F.when(F.col("id") < 300, "가").otherwise("b"), F.lit(" ")).alias("text")
    return spark.range(400).select("id", F.when(F.col("id") < 300, "ko").otherwise("en").alias("lang"), F.repeat(text, (F.col("id") % 50 * 20).cast("int")).alias("text"))


@pytest.mark.parametrize("pack", [True, False])
def test_pretraining_corpus(spark, pack):
    rates = registry.mixture("korean_english")
    out = jobs.pretraining_corpus(corpus(spark), "letters_ascending", ["id"], rates=rates, total=1000, pack=pack)
    rows = out.collect()
    assert all(len(r["inputs"]) == 1024 and len(r["targets"]) == 189 for r in rows)
    assert sorted((r["batch_id"], r["slot"]) for r in rows) == [(k // 8, k % 8) for k in range(len(rows))]
    assert sorted(r["pos"] for r in rows) == list(range(len(rows)))
    shares = {True: 0, False: 0}
    for r in rows:
        numbers = r["inputs_segmentation"] if pack else [1] * 1024
        for part in range(1, (r["members"] if pack else 1) + 1):
            ids = {i for i, n in zip(r["inputs"], numbers) if n == part and 1 < i < 327}
            letters, latin = {i for i in ids if i >= 259}, {i for i in ids if i == ord("b") + 3}
            assert bool(letters) != bool(latin)  # one source in each segment
            shares[bool(letters)] += 1
    assert shares == {True: 700, False: 300}


def test_recipes_by_source_and_one_encoder_in_the_plan(spark):
    recipes = {"ko": "letters_ascending", "en": "bytes_ascending"}
    out = jobs.pretraining_corpus(corpus(spark), recipes, ["id"], drop_last=True)
    assert out.count() % 8 == 0
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()  # texts are not encoded again
    examples = registry.recipe("letters_ascending").run(corpus(spark).withColumnRenamed("id", "record_no"))
    packs = Z.pack_examples(examples, ["group_id", "segment"], F.col("group_id"))
    assert "octet_length" not in packs._jdf.queryExecution().optimizedPlan().toString()


def test_missing_words_and_bad_lines(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("prefix\tinput_text\ttarget_text\nNA\tnull\tNone\nN/A\t\tNA \n")
    for line_ends in (True, False):
        rows = R.read_tsv(spark, str(tmp_path / "t.tsv"), line_ends=line_ends).collect()
        assert [tuple(r) for r in rows] == [("nan", "nan", "nan"), ("nan", "nan", "NA ")]
    (tmp_path / "a.json").write_text('{"text": "x"}\nbad\n')
    rows = R.read_jsonl_shards(spark, str(tmp_path / "a.json"), f"text string, {R.CORRUPT} string").orderBy("record_no").collect()
    assert [(r["text"], r[R.CORRUPT]) for r in rows] == [("x", None), (None, "bad")]


def test_unpaired_turns_and_unlabelled_texts(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    labels = spark.createDataFrame([(1, 0)], "id int, q int")
    assert R.zip_text_labels(texts, labels, "id", "q").count() == 1
    assert sorted(r["id"] for r in R.zip_text_labels(texts, labels, "id", "q", unlabelled=True).collect()) == [1, 2]



def test_scratch_tables_are_dropped(spark):
    from spanmill.session import drop_scratch, written

    df = written(spark.range(3), "numbers")
    assert df.count() == 3
    path = df.inputFiles()[0].removeprefix("file://")
    drop_scratch(spark)
    import os

    assert not os.path.exists(os.path.dirname(path))
