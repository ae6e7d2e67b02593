"""Operators against brute force on small data, at several partition counts."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.functions import spans as S
from spanmill.functions.encode import byte_ids, first_ids, letter_ids, letter_ids_expr
from spanmill.operators import corpus as K
from spanmill.operators import equations as E
from spanmill.operators import metrics as M
from spanmill.operators import mixing as X
from spanmill.operators import numbering as N
from spanmill.operators import packing as Z
from spanmill.operators import projection as P
from spanmill.operators import splitting as L
from spanmill.operators.corruption import corrupt

PARTITIONS = [1, 4, 8]


def digest(seed, tag, *keys):
    return hashlib.md5(":".join(str(k) for k in (seed, tag, *keys)).encode()).hexdigest()


def draw(seed, tag, *keys):
    return int(digest(seed, tag, *keys)[:8], 16)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """300 texts over three files: empty, short, long, Hangul and wide characters, one source hot."""
    rng = np.random.default_rng(11)
    alphabet = np.array(list("ab é한글힣😀\n"))
    rows = [
        (i, "".join(rng.choice(alphabet, int(n))), "hot" if i % 3 else f"s{i % 2}")
        for i, n in enumerate(rng.choice([0, 1, 2, 9, 50, 400], 300))
    ]
    path = str(tmp_path_factory.mktemp("texts") / "table")
    spark.createDataFrame(rows, "id int, text string, source string").repartitionByRange(3, "id").sortWithinPartitions(
        "id"
    ).write.parquet(path)
    return path, rows


def test_file_position_follows_sorted_files(spark, texts):
    path, rows = texts
    got = N.with_file_position(spark.read.parquet(path)).select("record_no", "id").collect()
    assert sorted(r["record_no"] for r in got) == list(range(300))
    assert all(r["record_no"] == r["id"] for r in got)


@pytest.mark.parametrize("split", ["90", "300", "128m"])
def test_line_position_of_split_and_gzip_files(spark, tmp_path, split):
    for f in range(4):
        (tmp_path / f"part-{f}.txt").write_text("".join(f"{f}-{i}\n" for i in range(50 * (f + 1))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4 or split == "128m"
        got = [r["value"] for r in N.with_line_position(lines).orderBy("record_no").collect()]
        numbers = [r["record_no"] for r in N.with_line_position(lines).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{f}-{i}" for f in range(4) for i in range(50 * (f + 1))]
    assert sorted(numbers) == list(range(500))


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_shuffled_position(spark, partitions):
    df = spark.range(777).repartition(partitions)
    got = {r["id"]: r["pos"] for r in N.with_shuffled_position(df, ["id"], seed=7).collect()}
    want = sorted(range(777), key=lambda i: digest(7, "order", i))
    assert [got[i] for i in want] == list(range(777))


def test_rank_sum(spark):
    df = spark.range(500).select((F.col("id") * 0.5).alias("k"), (F.col("id") % 7).alias("w"))
    got = [r["before"] for r in N.with_rank_sum(df, "k", "w").orderBy("k").collect()]
    assert got == [sum(j % 7 for j in range(i)) for i in range(500)]
    both = df.select((F.col("k") > 100).alias("g"), "k", "w")
    rows = N.with_rank_sum(both, "k", "w", within=["g"]).orderBy("k").collect()
    assert [r["before"] for r in rows] == [sum(j % 7 for j in range(0 if i <= 200 else 201, i)) for i in range(500)]


def test_quota_leaves_rows_where_they_are(spark):
    """Only the block at the edge of a quota is shuffled, and a large quota of a small source makes no large arrays."""
    df = spark.range(3000).select("id", F.when(F.col("id") < 10, "few").otherwise("many").alias("lang"))
    mixed = X.mix_fixed_rates(df, "lang", ["id"], {"few": 0.9, "many": 0.1}, 1_000_000)
    got = {r["lang"]: (r["n"], r["most"]) for r in mixed.groupBy("lang").agg(F.count("*").alias("n"), F.max("epoch").alias("most")).collect()}
    assert got == {"few": (900_000, 89_999), "many": (100_000, 33)}
    per_row = mixed.where("lang = 'many'").groupBy("id").count()
    digests = sorted(range(10, 3000), key=lambda i: digest(1, "mix", "many", i))
    assert {r["id"] for r in per_row.where("count = 34").collect()} == set(digests[: 100_000 % 2990])


@pytest.mark.parametrize("leak", [False, True])
def test_holdout(spark, leak):
    df = spark.range(950).withColumnRenamed("id", "record_no")
    split = L.split_every_nth(df, every=10, cap=20)
    held = {r["record_no"] for r in split.where("split = 'eval'").collect()}
    assert held == {10 * k - 1 for k in range(1, 21)}
    train = {r["record_no"] for r in L.train_records(df, every=10, cap=20, leak_compat=leak).collect()}
    assert train == (set(range(950)) if leak else set(range(950)) - held)
    assert {r["record_no"] for r in L.eval_records(df, every=10, cap=20).collect()} == held


def test_holdout_does_not_leak_below_the_cap(spark):
    df = spark.range(150).withColumnRenamed("id", "record_no")
    assert L.train_records(df, every=10, cap=20, leak_compat=True).count() == 135


def test_fraction_and_sample(spark):
    df = spark.range(2000)
    split = {r["id"]: r["split"] for r in L.split_fraction(df, ["id"], 80, seed=3).collect()}
    assert all((split[i] == "train") == (draw(3, "split", i) % 100 < 80) for i in range(2000))
    kept = {r["id"] for r in L.sample_bernoulli(df, ["id"], 0.25, seed=3).collect()}
    assert kept == {i for i in range(2000) if draw(3, "sample", i) < 2**30}
    assert [r["id"] for r in L.limit_cap(df, ["id"], 5).collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_mixture_quotas(spark, partitions):
    df = spark.range(600).select("id", F.when(F.col("id") < 60, "small").when(F.col("id") < 580, "big").otherwise("unused").alias("s"))
    mixed = X.mix_fixed_rates(df.repartition(partitions), "s", ["id"], {"small": 0.7, "big": 0.3}, 500).collect()
    sizes = Counter(r["s"] for r in mixed)
    assert sizes == {"small": 350, "big": 150}
    small = Counter(r["id"] for r in mixed if r["s"] == "small")
    order = sorted(range(60), key=lambda i: digest(1, "mix", "small", i))
    assert all(small[i] == (6 if i in order[:50] else 5) for i in range(60))
    big = {r["id"] for r in mixed if r["s"] == "big"}
    assert big == set(sorted(range(60, 580), key=lambda i: digest(1, "mix", "big", i))[:150])
    assert all(r["epoch"] == 0 for r in mixed if r["s"] == "big")


def test_temperature_rates(spark):
    df = spark.range(1100).select(F.when(F.col("id") < 1000, "a").otherwise("b").alias("s"))
    rates = {r["s"]: r["rate"] for r in X.temperature_rates(df, "s").collect()}
    assert rates["a"] == pytest.approx(1000**0.3 / (1000**0.3 + 100**0.3))
    capped = {r["s"]: r["rate"] for r in X.temperature_rates(df, "s", 1.0, maximum=300).collect()}
    assert capped == {"a": pytest.approx(0.75), "b": pytest.approx(0.25)}


def test_batches(spark):
    df = spark.range(35).withColumnRenamed("id", "pos")
    rows = X.batch_assign(df, "pos", 16).collect()
    assert all((r["batch_id"], r["slot"]) == divmod(r["pos"], 16) for r in rows) and len(rows) == 35
    assert X.batch_assign(df, "pos", 16, drop_last=True).count() == 32
    plan = X.batch_plan(df, 4, gpus=2, accumulate=2, epochs=3).first()
    assert (plan["examples"], plan["batches"], plan["steps"]) == (35, 4, 6)


def test_first_ids_are_the_first_of_all(spark, texts):
    path, _ = texts
    for encode in (byte_ids, letter_ids):
        df = spark.read.parquet(path).select(first_ids("text", 37, encode).alias("a"), F.slice(encode("text"), 1, 37).alias("b"))
        assert df.where("a <> b").count() == 0


def python_ids(text):
    out = []
    for c in text:
        o = ord(c) - 0xAC00
        out += [259 + o // 588, 278 + o % 588 // 28, 299 + o % 28] if 0 <= o < 11172 else [b + 3 for b in c.encode()]
    return out


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_joined_segments_are_chunk_concat_split(spark, texts, partitions):
    path, rows = texts
    length, group, chunk = 60, 16, 128
    streams = {}
    for i, text, _ in rows:
        ids = python_ids(text)
        if ids:
            start = chunk * (draw(1, "chunk", i) % math.ceil(len(ids) / chunk))
            streams.setdefault(i // group, []).extend(ids[start : start + chunk])
    want = {(g, k): ids[k * length : (k + 1) * length] for g, ids in streams.items() for k in range(math.ceil(len(ids) / length))}
    df = spark.read.parquet(path).repartition(partitions)
    got = K.joined_segments(df, "text", "id", letter_ids, length, group, chunk).collect()
    assert {(r["group_id"], r["segment"]): r["ids"] for r in got} == want and len(got) == len(want)

    ids = df.select("id", letter_ids("text").alias("ids"))
    chunks = K.random_chunk(ids, "ids", ["id"], chunk)
    assert chunks.count() == sum(1 for r in rows if r[1])
    chained = K.split_segments(K.concat_tokens(ids, "ids", "id", group, chunk), "ids", length, ["group_id"])
    assert {(r["group_id"], r["segment"]): r["ids"] for r in chained.collect()} == want


def test_joining_moves_the_text_once(spark, texts):
    df = K.joined_segments(spark.read.parquet(texts[0]), "text", "id", letter_ids_expr, 60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_corruption_rebuilds_and_fits(spark, texts):
    segments = K.joined_segments(spark.read.parquet(texts[0]), "text", "id", letter_ids, S.span_lengths()[0], 64)
    source = {(r["group_id"], r["segment"]): r["ids"] for r in segments.collect()}
    pairs = corrupt(segments, ["group_id", "segment"], S.LETTERS_ASCENDING, lengths=(1024, 189)).collect()
    assert len(pairs) == len(source)
    for r in pairs:
        assert len(r["inputs"]) <= 1024 and len(r["targets"]) <= 189
        assert r["inputs"][-1] == 1 and r["targets"][-1] == 1
        masked, k = {}, None
        for t in r["targets"][:-1]:
            if t >= 327:
                k = t
                masked[k] = []
            else:
                masked[k].append(t)
        rebuilt = [y for t in r["inputs"][:-1] for y in (masked[t] if t >= 327 else [t])]
        assert rebuilt == source[(r["group_id"], r["segment"])]


def test_pack_ids_of_the_worked_example(spark):
    rows = [(i, [9] * n) for i, n in enumerate([5, 4, 3, 8, 2, 2])]
    df = spark.createDataFrame(rows, "id int, inputs array<int>")
    packed = Z.pack_examples(df, ["id"], F.lit(0), {"inputs": 10}, {"inputs": 1}).orderBy("id").collect()
    assert [(r["id"], r["members"]) for r in packed] == [(0, 2), (2, 1), (3, 2), (5, 1)]
    assert packed[0]["inputs"] == [9] * 9 + [0]
    assert packed[0]["inputs_segmentation"] == [1] * 5 + [2] * 4 + [0]
    assert packed[0]["inputs_position"] == [0, 1, 2, 3, 4, 0, 1, 2, 3, 0]
    assert packed[2]["inputs"] == [9] * 9 + [1]


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_packing_loses_nothing(spark, partitions):
    rng = np.random.default_rng(5)
    limits = {"inputs": 40, "targets": 20}
    rows = [
        (i, [int(x) for x in rng.integers(3, 259, rng.integers(1, 40))] + [1], [int(x) for x in rng.integers(3, 259, rng.integers(0, 20))] + [1])
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id int, inputs array<int>, targets array<int>").repartition(partitions)
    packed = Z.pack_examples(df, ["id"], F.floor(F.col("id") / 50), limits).collect()
    seen = []
    for r in packed:
        runs = {f: [] for f in limits}
        for f, limit in limits.items():
            assert len(r[f]) == len(r[f + "_segmentation"]) == len(r[f + "_position"]) == limit
            for k in range(1, r["members"] + 1):
                places = [i for i, s in enumerate(r[f + "_segmentation"]) if s == k]
                assert [r[f + "_position"][i] for i in places] == list(range(len(places)))
                runs[f].append([r[f][i] for i in places])
        seen += list(zip(runs["inputs"], runs["targets"]))
    cut = lambda ids, n: ids[:n] if len(ids) < n else ids[: n - 1] + [min(ids[n - 1], 1)]
    assert sorted(seen) == sorted((cut(a, 40), cut(b, 20)) for _, a, b in rows)
    assert len(packed) < 400

    # Next-fit by hand, in key order within each bucket.
    want = []
    for bucket in range(8):
        used = None
        for i, a, b in rows[bucket * 50 : bucket * 50 + 50]:
            if len(a) + 2 > 40 or len(b) + 1 > 20:
                want.append((i, 1))
            elif used and used[0] + len(a) <= 40 and used[1] + len(b) <= 20:
                used = (used[0] + len(a), used[1] + len(b))
                want[used_at] = (want[used_at][0], want[used_at][1] + 1)
            else:
                used, used_at = (len(a), len(b)), len(want)
                want.append((i, 1))
    assert sorted((r["id"], r["members"]) for r in packed) == sorted(want)


def test_padding_without_packing(spark):
    df = spark.createDataFrame([(0, [5, 6, 1], [7, 8, 9, 4])], "id int, inputs array<int>, targets array<int>")
    row = Z.pad_examples(df, ["id"], {"inputs": 5, "targets": 3}).first()
    assert row["inputs"] == [5, 6, 1, 0, 0] and row["targets"] == [7, 8, 1]


PROBLEMS = [("x=1(1/2)*3:4", "1.125"), ("x=2+2", "5"), ("x=2+*", "4"), ("x=1/0", "1"), (None, "1"), ("x=5%", "0.05"), ("x=3", "3(0/1)")]


def test_equation_verdicts_and_rates(spark):
    df = E.verify_equations(spark.createDataFrame(PROBLEMS, "equation string, ans string"))
    assert [r["verdict"] for r in df.collect()] == ["right", "wrong", "error", "error", "error", "right", "right"]
    rates = E.verdict_rates(df).first()
    assert rates["n"] == 7 and rates["right_rate"] == pytest.approx(300 / 7) and rates["error_rate"] == pytest.approx(300 / 7)


def test_scores_and_subsets(spark):
    predicted = spark.createDataFrame([(1, "2*3"), (2, "2*4"), (3, "2*"), (4, "6/2")], "id int, predicted string")
    target = spark.createDataFrame([(1, "6"), (2, "6"), (3, "6"), (4, "x=3")], "id int, target_text string")
    scored = E.score_predictions(predicted, target, ["id"])
    assert {r["id"]: r["verdict"] for r in scored.collect()} == {1: "right", 2: "wrong", 3: "error", 4: "right"}
    assert {r["id"] for r in P.drop_listed(target, scored.where("verdict <> 'right'"), ["id"]).collect()} == {1, 4}
    assert {r["id"] for r in P.keep_listed(target, scored.where("verdict = 'error'"), ["id"]).collect()} == {3}


def test_class_metrics(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4
    got = M.class_metrics(spark.createDataFrame(rows, "t int, p int"), "t", "p").first()
    assert got.asDict() == {"n": 10, "accuracy": 0.7, "precision": 0.75, "recall": 0.6, "f1": pytest.approx(2 / 3)}
    none = M.class_metrics(spark.createDataFrame([(0, 0)], "t int, p int"), "t", "p").first()
    assert none["f1"] == 0 and none["accuracy"] == 1


@pytest.mark.parametrize(
    "predicted,truth,exact,f1",
    [
        ("The cat sat!", "cat sat", 1.0, 1.0),
        ("cat cat dog", "cat dog dog", 0.0, 2 / 3),
        ("", "the", 1.0, 1.0),
        ("", "cat", 0.0, 0.0),
        ("a b", "c", 0.0, 0.0),
    ],
)
def test_text_overlap(spark, predicted, truth, exact, f1):
    df = spark.createDataFrame([(predicted, truth)], "p string, t string")
    row = M.text_overlap_metrics(df, "p", "t").first()
    assert row["exact"] == exact and row["f1"] == pytest.approx(f1)


def test_correlation_with_hot_ties(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 500, 3000)).astype(float)
    y = x * 2 + rng.normal(0, 300, 3000).round()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    got = M.corr_metrics(df, "x", "y").first()

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    assert got["n"] == 3000
    assert got["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
