"""Lines that hold a Python literal, of any shape, as VARIANT records.

The language's own safe reader takes tuples, sets, nested containers, adjacent strings, prefixes and escapes; a batch of lines at a
time becomes JSON text, and that a VARIANT. Lines of a batch that differ in plain values only share a shape: the reader is asked
about the shape, and lines of a known one have their values put in. A line with anything else goes through the reader itself.

What JSON has not is spelled so: tuples and sets are arrays (sets in order of their spelling), bytes are their Latin-1 text, keys are
strings, complex and infinite numbers and whole numbers of more than 38 digits are strings. A repeated key keeps its last value.
"""

from __future__ import annotations

import ast
import json
import math
import re
import sys
import warnings
from codecs import unicode_escape_decode
from collections import Counter
from collections.abc import Callable
from functools import partial
from json.encoder import encode_basestring as quoted
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST_NUMBER = 10**38

_SINGLE = r"""'(?!'')[^'\\\x00\r\n]*+(?:\\[^\x00\r\n][^'\\\x00\r\n]*+)*+'"""
_STRING = rf"""(?:{_SINGLE}|{_SINGLE.replace("'", '"')})"""
_DIGITS = r"(?:0|[1-9][0-9]{0,37}+)(?:\.[0-9]{1,300}+)?(?:[eE][+-]?[0-9]{1,3}+)?(?![\w.])"
_ANY = rf"{_STRING}|(?<![\w.])(?:-?{_DIGITS}|(?:True|False|None)(?!\w))"
#: The text before a plain value, and the value: a string without its prefix, a decimal number or a constant. Or all the rest.
_VALUE = re.compile(rf"""([^'"0-9TFN-]*+)({_ANY})|([\s\S]+)""")
# Values that JSON spells alike: strings without quotes and escapes, by the text between their quotes, and whole numbers.
_ALIKE = [r"""'(?!'')([^'"\\\x00-\x1f]*+)'""", r'''"(?!"")([^"\\\x00-\x1f]*+)"''', r"(?<![\w.])(0|-?[1-9][0-9]{0,37}+)(?![\w.])"]
_CONSTANTS = {"True": "true", "False": "false", "None": "null", "-0": "0"}
# Kinds of values by their first character: where one of a kind stands, the grammar takes any other of it.
_KINDS = dict.fromkeys("'\"", _STRING) | dict.fromkeys("0123456789", _DIGITS) | {"-": f"-{_DIGITS}", "T": "True", "F": "False", "N": "None"}
_MARK = "\x7f"  # around the number of a value in a template
OFTEN = 100  # lines of a batch after which what they have in common becomes one pattern
PATTERNS = 8  # when there are so many to be tried on a line, no more are made
MOST_VALUES = 200  # of a line that is matched by a pattern


def _plain(value: object) -> object:
    """The value in what JSON knows."""
    match value:
        case None | bool() | str():
            return value
        case int():
            return value if abs(value) < LONGEST_NUMBER else str(value)
        case float():
            return value if math.isfinite(value) else str(value)
        case dict():
            return {k if isinstance(k, str) else str(_plain(k)): _plain(v) for k, v in value.items()}
        case list() | tuple():
            return [_plain(v) for v in value]
        case set():
            return [_plain(v) for v in sorted(value, key=repr)]
        case bytes():
            return value.decode("latin-1")
    return str(value)


def _json_of(line: str | None) -> str | None:
    try:
        return None if line is None else json.dumps(_plain(ast.literal_eval(line.strip())), ensure_ascii=False)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def _value_json(value: str) -> str:
    if value[0] not in "'\"":
        if value in _CONSTANTS:
            return _CONSTANTS[value]
        if value.isdigit() or value[1:].isdigit():
            return value
        if not math.isfinite(number := float(value)):
            raise ValueError(value)
        return repr(number)
    if "\\" not in value:
        return quoted(value[1:-1])
    if value.isascii():
        return quoted(unicode_escape_decode(value[1:-1])[0])
    return quoted(ast.literal_eval(value))


def _raw_json(value: str) -> str:
    return quoted(value[1:-1])


def _bytes_json(value: str) -> str:
    if "\\" in value or not value.isascii():
        return quoted(_plain(ast.literal_eval(f"b{value}")))
    return quoted(value[1:-1])


def _raw_bytes_json(value: str) -> str:
    return quoted(_plain(ast.literal_eval(f"br{value}")))


_PREFIXES = {"": _value_json, "u": _value_json, "r": _raw_json, "b": _bytes_json, "br": _raw_bytes_json, "rb": _raw_bytes_json}


class _Shape:
    """What lines have in common that differ in plain values only: the text around these.

    Values in keys and in sets decide what is dropped and how it is sorted: each choice of them has a template of its own.
    """

    def __init__(self, gaps: tuple[str, ...], rest: str) -> None:
        self.gaps, self.rest = gaps, rest
        self.templates: dict[object, tuple | None] = {}  # () after the first line, None if the reader has to see each line
        self.broken: set[tuple[str, ...]] = set()
        self.prefixes = [re.search(r"\w*$", gap)[0].lower() for gap in gaps]
        # A quote here is of no value above; comments and line ends may hide a part of the line.
        self.plain = not re.search(r"""['"#\\\r\n]""", "".join(gaps) + rest) and all(p in _PREFIXES for p in self.prefixes)
        free = self._free() if self.plain else set()
        self.free = sorted(free)
        fixed = [i for i in range(len(gaps)) if i not in free]
        self.key = itemgetter(*fixed) if fixed else len

    def _line(self, values: list[str]) -> str:
        return "".join([text for pair in zip(self.gaps, values, strict=True) for text in pair]) + self.rest

    def _free(self) -> set[int]:
        """Which values may differ without a new template: all outside of keys and sets."""
        try:
            tree = ast.parse(self._line([f"'{_MARK}{i}{_MARK}'" for i in range(len(self.gaps))]).strip(), mode="eval")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return set()
        inner = [n.keys if isinstance(n, ast.Dict) else n.elts for n in ast.walk(tree) if isinstance(n, (ast.Dict, ast.Set))]
        fixed = {id(n) for nodes in inner for node in nodes if node is not None for n in ast.walk(node)}
        loose = [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and id(n) not in fixed]
        texts = [v.decode("latin-1") if isinstance(v, bytes) else v for v in loose if isinstance(v, (bytes, str))]
        return {int(i) for text in texts for i in re.findall(rf"{_MARK}([0-9]+){_MARK}", text)}

    def _template(self, values: tuple[str, ...]) -> tuple[list[str], list[tuple[Callable[[str], str], int, bool]]] | None:
        """JSON of the line around its free values; how each of these is spelled, its number, and whether it is a whole string."""
        if any(_MARK in v for v in values):
            return None
        marked = [f"'{_MARK}{i}{_MARK}'" if i in self.free else v for i, v in enumerate(values)]
        pieces = re.split(rf'("?){_MARK}([0-9]+){_MARK}("?)', (_json_of(self._line(marked)) or "").replace("%", "%%"))
        if [int(i) for i in pieces[2::4]] != self.free:
            return None
        texts, places = pieces[:1], []
        for before, i, after, follows in zip(pieces[1::4], pieces[2::4], pieces[3::4], pieces[4::4], strict=True):
            spell = _PREFIXES[self.prefixes[int(i)]]
            whole = bool(before and after)
            places.append((spell if whole else partial(_part_json, spell), int(i), whole))
            texts[-1] += "" if whole else before
            texts.append(follows if whole else after + follows)
        return texts, places

    def learn(self, values: tuple[str, ...], key: object, json_text: str | None) -> None:
        """Called with a line and what the reader made of it; a template is made when its key comes again."""
        if json_text is not None:
            self.templates[key] = () if key not in self.templates else self._template(values) if self.templates[key] == () else None
        elif self.plain:
            # If it is not for a value that the reader does not take, it is for the text around, whatever the values.
            try:
                for prefix, value in zip(self.prefixes, values, strict=True):
                    _PREFIXES[prefix](value)
                self.broken.add(self.kinds(values))
            except (ValueError, SyntaxError):
                pass

    @staticmethod
    def kinds(values: tuple[str, ...]) -> tuple[str, ...]:
        return tuple([_KINDS[value[0]] for value in values])

    def pattern(self, values: list[str]) -> Callable[[str], re.Match | None]:
        """Matches lines of this shape, with ``values`` as patterns of the values."""
        gaps = [re.escape(gap) for gap in self.gaps]
        return re.compile("".join([text for pair in zip(gaps, values, strict=True) for text in pair]) + re.escape(self.rest)).fullmatch

    def template_pattern(self, values: tuple[str, ...], template: tuple[list, list], alike: bool) -> tuple[Callable, str, list]:
        """A pattern of the lines of a template, the text that takes its groups, and how the groups are spelled that are not ``alike``."""
        texts, places = template
        patterns, text, spells = [re.escape(value) for value in values], texts[0], []
        for n, (spell, i, whole) in enumerate(places):
            kinds = _ALIKE if whole else _ALIKE[:2]
            kind = next((k for k in kinds if alike and "b" not in self.prefixes[i] and re.fullmatch(k, values[i])), None)
            patterns[i] = kind or f"((?>{_ANY}))"
            text += ('"%s"' if whole and kind in _ALIKE[:2] else "%s") + texts[n + 1]
            if kind is None:
                spells.append((n, spell))
        return self.pattern(patterns), text, spells

    def broken_pattern(self, values: tuple[str, ...]) -> Callable[[str], re.Match | None]:
        return self.pattern([f"(?<![\\w.])(?>{kind})" if kind is not _STRING else f"(?>{kind})" for kind in self.kinds(values)])


def _part_json(spell: Callable[[str], str], value: str) -> str:
    """A string that is joined with its neighbours."""
    if value[0] not in "'\"":
        raise ValueError(value)
    return spell(value)[1:-1]


class _Reader:
    """JSON of the lines of a batch; what it learns goes with the batch."""

    def __init__(self) -> None:
        self.shapes: dict[str, _Shape | None] = {}
        self.uses: Counter[object] = Counter()
        self.patterns: list[tuple[Callable[[str], re.Match | None], str | None, list]] = []

    def json_of(self, line: str | None) -> str | None:
        if not line:
            return _json_of(line)
        try:
            for fullmatch, text, spells in self.patterns:
                if m := fullmatch(line):
                    if text is None:
                        return None
                    values = list(m.groups())
                    for n, spell in spells:
                        values[n] = spell(values[n])
                    return text % tuple(values)
            return self._json_by_shape(line)
        except (ValueError, SyntaxError):  # a value that is none, as '\x4'
            return _json_of(line)

    def _json_by_shape(self, line: str) -> str | None:
        gaps, values, rests = zip(*_VALUE.findall(line), strict=True)
        if rest := rests[-1]:
            gaps, values = gaps[:-1], values[:-1]
        name = "'".join((*gaps, rest))
        shape = self.shapes.get(name)
        if shape is None:  # a shape that comes once is not worth learning
            self.shapes[name] = _Shape(gaps, rest) if name in self.shapes else None
            return _json_of(line)
        if len(shape.gaps) != len(gaps):  # there are quotes in the rest
            return _json_of(line)
        key = shape.key(values)
        if template := shape.templates.get(key):
            texts, places = template
            if self._is_often((name, key), values):
                self.patterns.insert(0, shape.template_pattern(values, template, alike=True))
                self.patterns.append(shape.template_pattern(values, template, alike=False))
            return "%s".join(texts) % tuple([spell(values[i]) for spell, i, _ in places])
        if shape.broken and (kinds := shape.kinds(values)) in shape.broken:
            if self._is_often((name, kinds), values):
                self.patterns.append((shape.broken_pattern(values), None, []))
            return None
        json_text = _json_of(line)
        shape.learn(values, key, json_text)
        return json_text

    def _is_often(self, what: object, values: tuple[str, ...]) -> bool:
        self.uses[what] += 1
        return self.uses[what] == OFTEN and len(self.patterns) < PATTERNS and len(values) <= MOST_VALUES


def _json_of_batch(lines: pa.Array) -> pa.Array:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of escapes that mean nothing
        limit = sys.get_int_max_str_digits()
        sys.set_int_max_str_digits(0)
        try:
            reader = _Reader()
            return pa.array([reader.json_of(line) for line in lines.to_pylist()], pa.string())
        finally:
            sys.set_int_max_str_digits(limit)


def literal_record(line: Column | str) -> Column:
    """A VARIANT of the literal in each line; null if there is none."""
    return F.try_parse_json(F.arrow_udf(_json_of_batch, T.StringType())(line))


def read_literal_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``record`` (VARIANT) of each line that holds a literal, and ``bad_line`` of each other; blank lines go."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    read = lines.select("value", literal_record("value").alias("record"))
    return read.select("record", F.when(F.col("record").isNull(), F.col("value")).alias("bad_line"))
