"""The audit against a plain count, in cells of several sizes."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanmill.llm import source_divergence as audit_of

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string, block string"


def plain(rows: list[tuple]) -> list[tuple]:
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        data = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", data)
        counts[lang, source].update(words)
        holders[lang].update(set(words))
    out = []
    for lang in holders:
        kept = sorted((t for t, n in holders[lang].items() if n >= 30), key=str.encode)
        groups = sorted({s for own, s in counts if own == lang}, key=str.encode)
        whole = Counter()
        for s in groups:
            whole.update(counts[lang, s])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in groups}, share(whole)
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:50])):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def rows(n: int = 900) -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["Ab", "é", "日本", "x1y", "z_w", *(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150))]
    found = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else rng.choice([None, "", "a", "b", "ö", "B", "empty"])
        text = None if source == "empty" else " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        found.append((k // 2, text, rng.choice(["en", "en", "de", None]), source, "clash", "clash", "clash"))
    found += [found[0]] * 40  # repeated rows
    found += [(7, "long " * 300_000 + "ab", "en", "a", None, None, None), (8, "only here", "xx", "s", None, None, None), (9, "", "xx", "t", None, None, None)]
    return found


@pytest.mark.parametrize("groups, terms", [(32, 1024), (2, 16)])
def test_equals_plain_count(spark, monkeypatch, groups, terms):
    monkeypatch.setattr(audit_of, "GROUPS", groups)
    monkeypatch.setattr(audit_of, "TERMS", terms)
    monkeypatch.setattr(audit_of, "HELD", 50 if groups == 2 else 1 << 18)
    data = rows()
    found = audit_of.audit(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == plain(data)


def test_empty_table_and_one_source(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    assert audit_of.audit(frame.limit(0)).count() == 0
    assert audit_of.audit(spark.createDataFrame([(1, "a b", "en", "s", "", "", "")], SCHEMA)).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([[0, 1, 8_999_999_999_999_990, 123_456_789_012_345]], np.int64)
    total, v = int(counts.sum()), 4
    found = audit_of.shares(counts, np.array([total], np.int64), v)[0].tolist()
    assert found == [1 + 10**9 * (c + 5) // (total + 5 * v) for c in counts[0].tolist()]
