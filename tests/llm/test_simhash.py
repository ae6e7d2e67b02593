"""SimHash groups against fingerprints and links worked out plainly, and the defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from spanmill.llm import simhash
from spanmill.llm.components import components
from spanmill.session import written

SCHEMA = "doc_id bigint, text string, bits string, component_id string"


def plain_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    counts = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def roots(bits: list[int]) -> list[int]:
    """The least index reachable over two differing bits, by comparing all."""
    parent = list(range(len(bits)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(bits)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(bits))]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def test_fingerprints_and_defined_cases(spark):
    texts = [None, "", " \t\n", "one", "one two", "one two three", "A b C d", "a b c d", "ééé ẞ   x y", "x " * 70000, "w1 " * 9]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["bits"] for r in simhash.fingerprints(docs).collect()}
    assert found == {k: signed(plain_fingerprint(t)) for k, t in enumerate(texts)}
    group = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs).collect()}
    assert [group[k] for k in (0, 1, 2)] == [0, 0, 0] and group[7] == 6
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))


def test_empty_table_repeated_and_null_ids(spark):
    assert simhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", "", ""), (4, "a b c d", "", ""), (4, "a b c d", "", ""), (None, "z", "", "")], SCHEMA)
    rows = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.groups(docs).select("doc_id", "component_id").collect() if r["component_id"])
    assert rows == [(-1, 4), (4, 4), (4, 4)]
    kept = [(r["doc_id"], r["text"]) for r in simhash.first_of_each(docs).collect()]
    assert sorted(kept, key=repr) == [(4, "a b c d"), (None, "z")]


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"v{k}" for k in range(30_000))
    near = [f"{words} w{k}" for k in range(3)]
    bits = [plain_fingerprint(t) for t in near]
    assert all((bits[0] ^ b).bit_count() <= 2 for b in bits)
    rows = [(None, "only null ids", "b", ""), (None, "only null ids", "a", ""), (7, "same", "x", "y"), (7, "same", "x", "y"), (7, "same", None, "y")]
    rows += [(9, near[0], "", ""), (9, near[1], "", ""), (9, near[1], "", ""), (12, near[2], "", ""), (None, near[2], "", "")] + [(20, "often", "", "")] * 500
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = simhash.first_of_each(docs)
    assert kept.dtypes == docs.dtypes
    found = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.groups(docs).collect()}
    assert (12, 9) in groups and (None, 9) in groups
    assert [f[0] for f in found] == [0, 7, 9, 20] and found[0][1] == "only null ids" and found[2][1] in near[:2]


def test_a_text_stays_though_its_id_stands_on_a_copy_of_another(spark):
    a, b = "one text about the sea and its ships", "quite other words of a far mountain road"
    docs = spark.createDataFrame([(3, a, "", ""), (5, a, "", ""), (5, b, "", ""), (8, b, "", "")], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.first_of_each(docs).collect()) == [(3, a), (5, b)]


@pytest.mark.parametrize("cell", [2, simhash.CELL])
def test_links_connect_what_comparing_all_connects(spark, monkeypatch, cell):
    """Random clusters, chains and one dense cluster; with a small cell limit the finer grid does most of the work."""
    monkeypatch.setattr(simhash, "CELL", cell)
    draw = random.Random(5)
    bits = {0, (1 << 64) - 1, 1, 7}
    for size in (1, 4, 300):
        for _ in range(6 if size < 300 else 1):
            base = draw.getrandbits(64)
            for _ in range(size):
                x = base
                for _ in range(draw.randrange(4)):
                    x ^= 1 << draw.randrange(64)
                bits.add(x)
    x = draw.getrandbits(64)
    for k in range(40):  # a chain whose ends are far apart
        x ^= 3 << (k * 7) % 63
        bits.add(x)
    bits = sorted(bits)
    frame = spark.createDataFrame([(signed(b),) for b in bits], "bits bigint")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    want = roots(bits)
    mine = {}
    for k, b in enumerate(bits):
        mine.setdefault(found.get(signed(b), signed(b)), []).append(k)
    other = {}
    for k, root in enumerate(want):
        other.setdefault(root, []).append(k)
    assert sorted(mine.values()) == sorted(other.values())


def test_what_each_fingerprint_becomes_is_never_broadcast(spark, monkeypatch):
    """Spark takes cells and points, many for each fingerprint, for as small as the table of fingerprints."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(simhash, "CELL", 2)
    docs = written(spark.createDataFrame([(k, f"text {k % 30}", "", "") for k in range(90)], SCHEMA), "docs")
    plans["grouped"] = simhash.grouped(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    distinct = written(spark.range(50).selectExpr("id AS bits"), "distinct")
    plans["links"] = simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
    for name, joined in (("cells", r"\[cell#"), ("links", r"\[point#"), ("grouped", r"\[bits#")):
        assert re.search(f"SortMergeJoin {joined}", plans[name]), name
        assert not re.search(f"BroadcastHashJoin {joined}", plans[name]), name


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_components_of_odd_links(spark, monkeypatch, chunk):
    monkeypatch.setattr("spanmill.llm.components.CHUNK", chunk)
    links = spark.createDataFrame([(1, 1), (2, 9), (9, 5), (5, 2), (None, 3), (3, 4), (4, 3), (3, 4)], "a bigint, b bigint")
    assert sorted(components(links).collect()) == [(4, 3), (5, 2), (9, 2)]
    assert components(links.where("a > 99")).count() == 0


def test_query_on_documents(spark):
    from spanmill.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    bits = [plain_fingerprint(r["text"]) for r in docs]
    least = roots(bits)
    want = sorted((r["doc_id"], f"{b:016x}", docs[k]["doc_id"]) for r, b, k in zip(docs, bits, least, strict=True))
    found = QUERIES["op10_simhash_near_dedup"](spark, sf)
    assert sorted(map(tuple, found.collect())) == want
    assert found.where(F.length("fingerprint") != 16).count() == 0
