"""Text-cleaning rules as native regular-expression chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters and patterns of the cleaning rules.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
REVIEW_PUNCTUATION = ".;:!'?,\"()[]"
REVIEW_BREAKS = f"<br[{WHITE}]*/><br[{WHITE}]*/>"
REVIEW_STROKES = "-/"
RATIO = "([0-9]+):([0-9]+)"
MIXED_NUMBER = r"([0-9]+)\(([0-9]+)/([0-9]+)\)"
PERCENT = r"[0-9]+(?:\.[0-9]+)?%"
ANSWER_PREFIX = "x="


def clean_review_text(text: Column) -> Column:
    """Strip white space, then delete punctuation, doubled line breaks, hyphens and slashes."""
    bare = F.translate(F.btrim(text, F.lit(WHITE)), REVIEW_PUNCTUATION, "")
    return F.translate(F.regexp_replace(bare, REVIEW_BREAKS, ""), REVIEW_STROKES, "")


def strip_target_prefix(equation: Column) -> Column:
    return F.replace(equation, F.lit(ANSWER_PREFIX), F.lit(""))


def _mixed_numbers(text: Column) -> Column:
    return F.regexp_replace(text, MIXED_NUMBER, r"($1*$3+$2)/($3)")


def normalize_equation(text: Column, strict: bool = False) -> Column:
    """Ratios, mixed numbers and percentages as plain arithmetic.

    Each percentage found is replaced everywhere in the text, one after the
    other, so ``5%`` also rewrites the end of ``15%``. ``strict`` rewrites each
    percentage in its own place only.
    """
    text = F.regexp_replace(strip_target_prefix(text), RATIO, r"($1/$2)")
    text = _mixed_numbers(text)
    if strict:
        text = F.regexp_replace(text, f"({PERCENT[:-1]})%", "($1/100)")
    else:
        found = F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0))
        fraction = lambda p: F.concat(F.lit("("), F.rtrim(p, F.lit("%")), F.lit("/100)"))
        text = F.aggregate(found, text, lambda t, p: F.replace(t, p, fraction(p)))
    return _mixed_numbers(text)


def clean_prediction(decoded: Column, legacy: bool = True) -> Column:
    """Answer text of a decoded prediction.

    ``legacy`` drops all padding, then the first character and the last four;
    otherwise padding and a closing ``</s>`` are dropped by name.
    """
    bare = F.replace(decoded, F.lit("<pad>"), F.lit(""))
    if legacy:
        return F.substring(bare, F.lit(2), F.greatest(F.char_length(bare) - 5, F.lit(0)))
    return F.trim(F.regexp_replace(bare, "</s>$", ""))


def strip_trailing_pad(decoded: Column) -> Column:
    return F.regexp_replace(decoded, "(?:<pad>)+$", "")
