"""The pipeline's decisions against plain ones, stage by stage, and its rows as a query."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

from spanmill.llm import language_id, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    from test_decontamination import plain
    from test_simhash import plain_fingerprint, roots

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).select(F.lit(10**6).cast("bigint").alias("doc_id"), F.lit("12 34 ...").alias("text"), "lang", "source", "n_chars")
    nulls = docs.limit(1).select((F.lit(10**6) + 1).cast("bigint").alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[1:]])
    docs = docs.union(extra).union(nulls)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"] for r in out.collect()}
        assert after <= set(before) and out.count() == len(after)
        if name == "language_id":
            names = language_id.compressors(language_id.learned(docs))
            want = {d for d, t in before.items() if t and any(map(str.isalpha, t)) and language_id.classify(language_id.letters(t.lower().encode()), names)[1] >= 0.001}
            assert after == want and 10**6 not in after and len(after) > 0.9 * len(before)
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            least = roots([plain_fingerprint(before[d]) for d in ids])
            assert after == {ids[k] for k in least} and len(after) < len(before)
        elif name == "decontamination":
            assert after == {d for d, t in before.items() if not plain(t, items)[4]} and len(after) < len(before)
        elif name == "secret_scan":
            rules = [(r, re.compile(r.pattern)) for r in secret_scan.RULES]
            assert after == {d for d, t in before.items() if not any(len(m[r.group]) >= r.least for r, e in rules for m in e.finditer(t))}
        else:
            assert after == set(before)
        before = {d: before[d] for d in after}
        docs = out


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert 0 < rows.count() == rows.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_scan", "byte_bpe"]


def test_no_table_of_cells_is_broadcast_in_a_stage(spark, monkeypatch):
    from spanmill.llm import simhash

    plans, written = {}, simhash.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    rows = [(k, f"one text in {k % 9} forms", "en", "web", 20) for k in range(40)]
    docs = written(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "docs")
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").count() == 9
    assert re.search(r"SortMergeJoin \[cell#", plans["cells"]) and "Broadcast" not in plans["cells"]
