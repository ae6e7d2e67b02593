"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

A rule compares two counts of a text: ``1000 * part`` must lie between ``low * whole`` and ``high * whole``. Counts and verdicts are
Spark expressions over one scan: no user function, no shuffle, and whole numbers throughout, so every engine agrees.

Repeated word windows are found by sorting the 64-bit hashes of a text's windows; in a text of 10**5 words one in
10**9 finds two different windows with one hash.

Defined cases: a null text has no words and fails the base; a count over an empty whole (no lines, no words) passes its
rule. A repeated row is judged like any other. A word is what stands between white space, with its punctuation. Stop
words are compared in lower case; one with a comma is none. Other columns are not read. An empty table has no rows in the
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.binding import bind
from spanmill.llm.common import text_of

WINDOW = 8
MIN_WORDS = 20
#: Of 100 words, so many may stand in repeated windows.
MAX_REPEATED = 30

#: White space, and the signs that count as symbols.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent words of English, German, French and Spanish prose.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from",
    "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als",
    "de la le et les en des un du une que est pour par dans avec qui pas sur au",
    "de la que el en y los las se del un por con no una su para es al lo",
)


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * part / whole <= high``; ``None`` is no bound. ``part`` and ``whole`` are counts of :func:`counts`."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def broken(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        bounds = [part < whole * self.low] if self.low is not None else []
        bounds += [part > whole * self.high] if self.high is not None else []
        return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("capitals", "n_capitals", "word_chars", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)


def stop_words() -> list[str]:
    return sorted(set(" ".join(STOP_WORDS).split()))


def repeated(hashes: Column) -> Column:
    """Words that stand in windows found twice or more."""

    def covered(ordered: Column) -> Column:
        """``ordered``: hash and place of each window, sorted."""
        twin = lambda one, k: F.coalesce(F.get(ordered, k).h == one.h, F.lit(False))
        found = F.filter(ordered, lambda one, k: twin(one, k - 1) | twin(one, k + 1))
        places = F.sort_array(F.transform(found, lambda one: one.i))
        # Up to the next such window, or the whole window.
        parts = lambda p: F.transform(p, lambda x, k: F.least(F.get(p, k + 1) - x, F.lit(WINDOW)))
        return F.aggregate(bind(places, parts), F.lit(0), lambda total, x: total + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(pairs, covered)).otherwise(0)


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and every count that rules may name, one row for each row."""
    words = F.array_remove(F.split("text", f"{WHITE}+"), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(NOT_WHITE))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.select("*", words.alias("words"), lines.alias("lines"))
    # Words by place, as a slice copies the whole array each time.
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    places = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.when(F.size("words") >= WINDOW, F.transform(places, window)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", hashes.alias("hashes"))
    found = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated(F.col("hashes")),
        "n_capitals": F.regexp_count("text", F.lit("[A-Z]")),
        "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(stop_words()))),
        "n_lines": F.size("lines"),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.rlike(rf"(\.\.\.|…){WHITE}*$"))),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(f"^{WHITE}*[-*•]"))),
    }
    return rows.select("doc_id", *(c.cast("bigint").alias(name) for name, c in found.items()))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, ``base_failed``, the names of the ``broken`` rules joined by commas, and ``kept``."""
    few = F.col("n_words") < MIN_WORDS
    again = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED
    broken = F.concat_ws(",", *(F.when(rule.broken(), F.lit(rule.name)) for rule in rules))
    found = counts(docs, doc_id, text).select("*", (few | again).alias("base_failed"), broken.alias("broken"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
