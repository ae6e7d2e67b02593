"""Records of any shape: Python literals and JSON of several shapes as VARIANT."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmill.operators import records as D
from spanmill.sources import literals as V

GOOD = {
    "{'a': 1, 'b': [1, (2, 'x'), {}]}": {"a": 1, "b": [1, [2, "x"], {}]},
    "('it' \"'s\" ' one',)": ["it's one"],
    "{'e': '\\x41\\u00e9\\n', r'\\n': b'\\xe9'}": {"e": "Aé\n", "\\n": "é"},
    "{'a': None, 'a': True, 2: False, (1, 2): -3.5}": {"a": True, "2": False, "[1, 2]": -3.5},
    "{3, 1, 2}": [1, 2, 3],
    "[" * 90 + "]" * 90: json.loads("[" * 90 + "]" * 90),
    "1" * 38: int("1" * 38),
    "1" * 5000: "1" * 5000,
    "1e999": "inf",
    "1+2j": "(1+2j)",
    "0x1F": 31,
    "  'blank around'  ": "blank around",
    "'''quotes ' and \" inside'''": "quotes ' and \" inside",
    "{'long': '" + "x" * 200_000 + "'}": {"long": "x" * 200_000},
}
BAD = ["f()", "{'a': 1", "a", "1 1", "'open", "{'a': b}", "[" * 5000 + "]" * 5000, "__import__('os')", "1 if x else 2", "\\", "é"]


def test_golden_literals(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("\n".join([*GOOD, "", *BAD, "   "]) + "\n")
    rows = V.read_literal_records(spark, str(path)).select(F.to_json("record").alias("j"), "bad_line").collect()
    assert sorted(r["bad_line"] for r in rows if r["bad_line"] is not None) == sorted(BAD)
    found = [json.loads(r["j"]) for r in rows if r["bad_line"] is None]
    spelled = lambda values: sorted(json.dumps(v, sort_keys=True) for v in values)
    assert spelled(found) == spelled(GOOD.values())


def test_null_and_none(spark):
    rows = spark.createDataFrame([("None",), (None,), ("[None]",)], "t string").select("t", V.literal_record("t").alias("r"))
    found = {r["t"]: r["j"] for r in rows.select("t", F.to_json("r").alias("j")).collect()}
    assert found == {"None": "null", None: None, "[None]": "[null]"}


def test_lines_of_one_shape_are_read_once(monkeypatch):
    values = ["'it\\'s'", '"\\u00e9%s"', "b'x'", "None", "-2.50", "0", "1e999", "r'\\d'", "'\\x4'", "'a' 'b'", "'a' b'c'", "'}'", "1 2"]
    lines = [f"{{'id': ({k}, 'n{k}'), 'set': {{2, 1}}, 'v': [{values[k % 13]}], 'w': 'x' \"{k}\"}}" if k % 5 else f"{{'id': {k}, 'call': f()}}" for k in range(4000)]
    lines += ["{'a': 1, 'a': %d}" % k for k in range(300)] + ["{%d: 0, 7: 1}" % (k % 9) for k in range(300)]
    wanted = [V._json_of(line) for line in lines]
    calls, read = [], ast.literal_eval
    monkeypatch.setattr(ast, "literal_eval", lambda text: calls.append(text) or read(text))
    assert V._json_of_batch(pa.array([*lines, None])).to_pylist() == [*wanted, None]
    assert wanted[1] == '{"id": [1, "n1"], "set": [1, 2], "v": ["é%s"], "w": "x1"}' and wanted[0] is None
    # Lines with a value that none is, or whose keys repeat, go through the reader; the others as often as there are shapes.
    assert len(calls) < 1800


@pytest.mark.parametrize("partitions", [1, 4])
def test_keys_chosen_at_run_time(spark, partitions):
    lines = ['{"q": "a", "use": "$.q"}', '{"body": {"q": 5}, "use": "$.body.q"}', '{"parts": ["x", {"y": null}], "use": "$.gone"}', '{"q": [1]}', "7", None, "bad"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(lines)], "k int, s string").repartition(partitions)
    df = df.select("k", F.try_parse_json("s").alias("record"))
    own = F.try_variant_get("record", "$.use", "string")
    found = D.rekey_records(df, "record", {"inputs": None, "first": ["$.q", "$.body.q", "$.parts[0]"], "own": own}, keep=["k"])
    got = {r["k"]: (r["inputs"], r["first"], r["own"]) for r in found.collect()}
    assert got == {
        0: ("", "a", "a"), 1: ("", "5", "5"), 2: ("", "x", None), 3: ("", "[1]", None), 4: ("", None, None), 5: ("", None, None), 6: ("", None, None)
    }
    assert sum(r["n"] for r in D.shapes(df, "record").collect()) == 7
    assert D.rekey_records(df.limit(0), "record", {"first": "$.q"}).count() == 0
