"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From it a Boolean query of trigrams is derived that every matching text satisfies. A
shard, a slice of documents, is indexed once: for each trigram that some query names, the documents that hold it. The
postings are intersected and united as the queries say, and only the candidates are verified with the expression. A rule
without mandatory trigrams, such as a run of hexadecimal digits, scans every document. Nothing is shuffled.

The index folds A-Z to lower case, so a query holds for either case; the expressions themselves decide.

Matches are leftmost and do not overlap within a rule; those whose measured group is too short are dropped after that.
Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then by the order of the rules.

Defined cases: a null text counts as empty and has no spans. Repeated documents are scanned each by itself. Names of
other columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import keep_rows, map_texts, text_of

MANY = 64


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of 16 and up among the longest runs
]
#: Published forms of keys that other services hand out.
MORE = [
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE + MORE

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def both(queries: list[Query]) -> Query:
    left = [q for q in queries if q is not True]
    return True if not left else left[0] if len(left) == 1 else ("and", left)


def either(queries: list[Query]) -> Query:
    return True if True in queries else queries[0] if len(queries) == 1 else ("or", queries)


def of_strings(strings: set[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return either([both([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def trigrams(pattern: str) -> Query:
    """The query of an expression, in lower case."""
    exact, query = _derive(list(parser.parse(pattern)))
    return both([query, of_strings(exact)]) if exact is not None else query


def _derive(nodes: list) -> tuple[set[str] | None, Query]:
    """The strings that match, if they are few, and else a query."""
    run: set[str] = {""}
    queries: list[Query] = []
    whole = True

    def cut() -> None:
        nonlocal run, whole
        queries.append(of_strings(run))
        run, whole = {""}, False

    for op, value in nodes:
        some, query = _strings(op, value)
        if query is not True:
            queries.append(query)
        if some is None:
            cut()
        elif len(run) * len(some) > MANY:
            cut()
            run = some
        else:
            run = {a + b for a in run for b in some}
        if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] != value[1] and some is not None and value[:2] != (0, 1):
            cut()
    if whole:
        return run, True
    queries.append(of_strings(run))
    return None, both(queries)


def _strings(op: int, value: object) -> tuple[set[str] | None, Query]:
    if op is kinds.LITERAL:
        return {chr(value).lower()}, True
    if op is kinds.AT:
        return {""}, True
    if op is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}, True
    if op is kinds.SUBPATTERN:
        return _derive(list(value[3]))
    if op is kinds.BRANCH:
        parts = [_derive(list(p)) for p in value[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), True
        return None, either([q if exact is None else of_strings(exact) for exact, q in parts])
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, inner = value
        exact, query = _derive(list(inner))
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, True
        if least == 0:
            return None, True
        if exact is None or len(exact) ** least > MANY:
            return None, query if exact is None else of_strings(exact)
        strings = {""}
        for _ in range(least):
            strings = {a + b for a in strings for b in exact}
        return strings, True
    return None, True


class Index:
    """Finds, for a shard of texts, the documents that satisfy each rule's query."""

    def __init__(self, queries: list[Query]):
        self.queries = queries
        named: set[str] = set()

        def gather(q: Query) -> None:
            if isinstance(q, str):
                named.add(q)
            elif isinstance(q, tuple):
                for part in q[1]:
                    gather(part)

        for q in queries:
            gather(q)
        # Trigrams beyond ASCII are left out of the index: they count as present, and the expression decides.
        self.place = {t: k for k, t in enumerate(sorted(t for t in named if t.isascii()))}
        letters = sorted(set("".join(self.place)))
        self.size = len(letters) + 1
        self.number = np.zeros(256, dtype=np.int32)
        for k, c in enumerate(letters):
            self.number[[ord(c), ord(c.upper())]] = k + 1
        self.known = np.full(self.size**3, -1, dtype=np.int32)
        for t, k in self.place.items():
            a, b, c = (int(self.number[ord(x)]) for x in t)
            self.known[(a * self.size + b) * self.size + c] = k

    def postings(self, content: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``[trigram, document]``: whether the document holds the trigram."""
        found = np.zeros((len(self.place), len(ends)), dtype=bool)
        if len(content) >= 3:
            n = self.number[content]
            which = self.known[(n[:-2] * self.size + n[1:-1]) * self.size + n[2:]]
            at = np.flatnonzero(which >= 0)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + 3 <= ends[doc]
            found[which[at[inside]], doc[inside]] = True
        return found

    def candidates(self, content: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each query, whether a document may match."""
        found = self.postings(content, ends)
        every = np.ones(len(ends), dtype=bool)

        def ask(q: Query) -> np.ndarray:
            if q is True or isinstance(q, str) and q not in self.place:
                return every
            if isinstance(q, str):
                return found[self.place[q]]
            return (np.logical_and if q[0] == "and" else np.logical_or).reduce([ask(part) for part in q[1]])

        return [ask(q) for q in self.queries]


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        self.index = Index([trigrams(r.pattern) for r in rules])

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """``start, order of the rule, end`` of every match of each text."""
        whole = texts.to_pylist()
        raw = [t.encode() for t in whole]
        content = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        for k, ((rule, expression), may) in enumerate(zip(self.rules, self.index.candidates(content, ends), strict=True)):
            for d in np.flatnonzero(may).tolist():
                for m in expression.finditer(whole[d]):
                    if len(m[rule.group]) >= rule.least:
                        out[d].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every document; the base rules come first."""
    names = [r.kind for r in rules]

    def start():
        scanner = Scanner(rules)

        def work(ids: pa.Array, texts: pa.Array) -> list:
            found = scanner.spans(texts)
            counts = [[sum(k == base for _, k, _ in f) for f in found] for base in range(len(BASE))]
            spelled = [[f"{names[k]}:{a}:{b}" for a, k, b in f] for f in found]
            base = [",".join(s for s, (_, k, _) in zip(x, f, strict=True) if k < len(BASE)) for x, f in zip(spelled, found, strict=True)]
            return [ids, *counts, base, [",".join(x) for x in spelled]]

        return work

    kinds_ddl = ", ".join(f"n_{r.kind} bigint" for r in BASE)
    found = map_texts(
        docs, [F.col(doc_id).cast("bigint"), text_of(text)], f"doc_id bigint, {kinds_ddl}, base string, spans string", start
    )
    sha = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[f"n_{r.kind}" for r in BASE], sha, "spans")


def without_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The documents, with all their columns, in which no rule finds anything."""

    def start():
        scanner = Scanner(rules)
        return lambda texts: [not f for f in scanner.spans(texts)]

    return keep_rows(docs, [text_of(text)], start)
