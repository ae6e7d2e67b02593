"""The sparse line index against plain reading."""

from __future__ import annotations

import glob
import gzip
import os

import pytest

from spanmill import session
from spanmill.sources import line_index as N
from spanmill.sources import readers as R


@pytest.fixture
def shards(tmp_path):
    """Files, and all their lines in sorted-file order."""
    texts = {
        "a.json": b"".join(b'{"text": "%d %s"}\n' % (k, b"x" * (k % 700)) for k in range(3000)),
        "b.json.gz": b"".join(b'{"text": "z%d"}\n' % k for k in range(500)) + b"\n\n" + '{"text": "é🙂"}'.encode(),
        "c.json": b"",
        "d.json": b"\n" + b'{"text": "cr"}\r\n' + b"not json\n" + '{"text": "日本 no end"}'.encode(),
        "e.json": b"one line",
    }
    lines = []
    for name, data in texts.items():
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        lines += data.removesuffix(b"\n").split(b"\n") if data else []
    return str(tmp_path), [line.decode() for line in lines]


@pytest.mark.parametrize("piece", ["20k", "128m"])
@pytest.mark.parametrize("every", [1, 7, 4096])
def test_entries_and_records(spark, shards, piece, every):
    path, lines = shards
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    try:
        index = session.written(N.line_index(spark, path, every), "index")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    entries = sorted(index.collect(), key=lambda r: r["line"])
    assert [r["line"] for r in entries] == [sum(e["lines"] for e in entries[:k]) for k in range(len(entries))]
    assert sum(r["lines"] for r in entries) == len(lines) and all(0 < r["lines"] <= every for r in entries)
    for r in entries:
        if r["file"].endswith(".json"):
            data = open(r["file"].removeprefix("file://").removeprefix("file:"), "rb").read()
            assert data[r["byte"] : r["byte"] + r["bytes"]].split(b"\n")[: r["lines"]] == [
                x.encode() for x in lines[r["line"] : r["line"] + r["lines"]]
            ]
    wanted = [0, 1, 2999, 3000, 3499, 3502, 3503, 3504, len(lines) - 1, *range(5, len(lines), 61)]
    numbers = spark.createDataFrame([(n,) for n in [*wanted, *wanted, -1, len(lines), 10**9, None]], "number bigint")
    found = {r["number"]: r["value"] for r in N.lines_at(index, numbers).collect()}
    assert found == {n: lines[n] for n in wanted}


def test_numbers_and_no_text_in_scratch(spark, shards):
    path, lines = shards
    before = set(session._made)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = R.read_jsonl_shards(spark, path, "text string, _corrupt_record string")
        rows = read.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = set(session._made) - before
    assert {os.path.basename(p).split("-")[0] for p in made} == {"pieces"}
    size = sum(os.path.getsize(f) for p in made for f in glob.glob(f"{p.removeprefix('file:')}/*.parquet"))
    assert size < 100_000
    numbers = {r["record_no"]: r["text"] or r["_corrupt_record"] for r in rows}
    assert len(numbers) == len(rows)
    assert set(numbers) == {k for k, line in enumerate(lines) if line.strip()}
    assert numbers[2999].startswith("2999 ") and numbers[3502] == "é🙂" and numbers[len(lines) - 1] == "one line"


def test_empty_folder_of_lines(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"")
    index = N.line_index(spark, str(tmp_path))
    assert index.count() == 0
    assert N.lines_at(index, spark.range(3).toDF("number")).count() == 0
