"""Counts and verdicts against a plain computation."""

from __future__ import annotations

import re
from collections import Counter

from spanmill.llm import quality_rules
from spanmill.llm.quality_rules import RULES, Rule

SCHEMA = "doc_id bigint, text string, n_words string, words string, hashes string"
PROSE = "The house of the man is in the town and it was for a long time on the hill with a view."


def plain(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_capitals": len(re.findall("[A-Z]", text)),
        "n_stop_words": sum(w.lower() in quality_rules.stop_words() for w in words),
        "n_lines": len(lines),
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines),
    }


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a " * 9, "\x0b\x0cx\x0by\x85z w", "é🙂 日本語", PROSE, PROSE * 3, f"{PROSE}\n{PROSE}\n\n \nend",
    "w1 w2 w3 w4 w5 w6 w7 w8 " + " ".join(f"v{k}" for k in range(40)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9", PROSE.upper() * 2,
    "\n".join(["- the of", "* and …", " • to... ", "x"] * 3), " ".join(f"{w}###" for w in PROSE.split()), "xyzzy " * 25, "Word" + "x" * 100_000,
    "the " * 60_000 + " ".join(f"u{k}" for k in range(60_000)), "line\r\nline\r\nother\r", "﻿bom the", "x" * 30 + " tail of the and " * 6,
]


def test_counts_and_verdicts(spark):
    rows = [(k, t, "clash", "clash", "clash") for k, t in enumerate(TEXTS)] + [(None, PROSE, None, None, None), (3, "one", "", "", "")]
    found = quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for k, text in [*enumerate(TEXTS), (None, PROSE)]:
        want, r = plain(text), by_id[k]
        assert {c: r[c] for c in want} == want, k
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        broken = [
            rule.name for rule in RULES
            if rule.low is not None and 1000 * want[rule.part] < rule.low * want[rule.whole]
            or rule.high is not None and 1000 * want[rule.part] > rule.high * want[rule.whole]
        ]
        assert (r["base_failed"], r["broken"], r["kept"]) == (failed, ",".join(broken), not failed and not broken)
    assert by_id[8]["kept"] and not by_id[12]["kept"] and not by_id[14]["kept"]


def test_other_tables_of_rules(spark):
    frame = spark.createDataFrame([(1, PROSE), (2, PROSE + " #")], "doc_id bigint, text string")
    rules = (Rule("no_symbols", "n_symbols", "n_words", None, 0), Rule("some_words", "n_words", "n_lines", 1_000, None))
    assert {r["doc_id"]: r["broken"] for r in quality_rules.judged(frame, rules).collect()} == {1: "", 2: "no_symbols"}
    assert {r["kept"] for r in quality_rules.judged(frame, ()).collect()} == {True}


def test_no_user_function_and_no_shuffle(spark):
    frame = spark.createDataFrame([(1, PROSE)], "doc_id bigint, text string")
    plan = quality_rules.judged(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow"))
    assert quality_rules.judged(frame.limit(0)).count() == 0
