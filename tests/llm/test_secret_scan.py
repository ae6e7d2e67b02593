"""Spans against plain scans of every text, and queries that every match satisfies."""

from __future__ import annotations

import hashlib
import random
import re

from spanmill.llm import secret_scan as ss

KEYS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYS) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain(text: str | None) -> list[tuple]:
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def texts() -> list[str | None]:
    draw = random.Random(2)
    parts = [
        *KEYS, "PassWord", "API_KEY", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abc",
        "é", "🙂", "\n", "ghp_" + "a1B2" * 9, "xoxb-123456789012", "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "+/=", "secret:abcdefghijklmnop",
    ]
    out: list[str | None] = [None, "", "aki", "İAKIA", "token=secret:abcdefghijklmnop", "AKIAAKIA" + "Z" * 20, "f" * 100_000]
    return out + ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(600)]


def test_against_plain_scans(spark):
    cases = texts()
    frame = spark.createDataFrame([(k, t, "c") for k, t in enumerate(cases)], "doc_id bigint, text string, spans string")
    names = [r.kind for r in ss.RULES]
    rows = {r["doc_id"]: r for r in ss.report(frame).collect()}
    assert len(rows) == len(cases)
    seen = set()
    for k, text in enumerate(cases):
        want = plain(text)
        r = rows[k]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == n for x in want) for n in range(3)], text
        spelled = ",".join(f"{names[n]}:{a}:{b}" for a, n, b in want)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in names[:3]] == (spelled.split(",") if spelled else [])
        starts = [(int(s.split(":")[1]), names.index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts)
        seen |= {s.split(":")[0] for s in spans}
    assert seen == set(names)
    kept = ss.without_secrets(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if not r["spans"]}
    assert ss.report(frame.limit(0)).count() == 0


def test_queries_of_expressions():
    assert ss.trigrams("abcd") == ("and", ["abc", "bcd"])
    assert ss.trigrams("[0-9a-f]{16,}") is True
    assert ss.trigrams("ab|cdef") is True
    assert ss.trigrams("(xyz|abc)+[0-9]*") == ("or", ["abc", "xyz"])
    assert ss.trigrams("ab?c") is True
    query = ss.trigrams(ss.ASSIGN)
    assert query[0] == "or" and ("and", ["pas", "ass", "ssw", "swo", "wor", "ord"]) in query[1]


def test_every_match_satisfies_its_query():
    """Holds for odd expressions too: what matches is always a candidate."""
    import numpy as np

    patterns = ["a(bc|d)+e", "(ab){2}c", "x?yz{1,3}w", "(foo|ba[rz])qux?", "abc(?:def)?ghi", "[ab]cd.*efg", "(?i:AbC)d", "(abc)*def", "^abc$"]
    letters = "abcdefghioqruwxyz"
    draw = random.Random(4)
    samples = ["abcbce", "ade", "ababc", "yzw", "xyzzzw", "fooqu", "barqux", "bazqu", "abcghi", "abcdefghi", "acd efg", "bcdefg", "ABCd", "def", "abcabcdef", "abc"]
    samples += ["".join(draw.choices(letters, k=8)) for _ in range(500)]
    raw = [s.encode() for s in samples]
    content, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    index = ss.Index([ss.trigrams(p) for p in patterns])
    for p, may in zip(patterns, index.candidates(content, ends), strict=True):
        matching = {k for k, s in enumerate(samples) if re.search(p, s)}
        assert matching and matching <= set(np.flatnonzero(may).tolist()), p
