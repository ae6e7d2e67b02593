"""Id layout of the byte + Hangul-letter vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The id layout.
PAD, EOS, UNK = 0, 1, 2
BYTE_BASE = 3  # ids 3..258 are UTF-8 bytes
INITIAL_BASE, INITIALS = 259, 19
VOWEL_BASE, VOWELS = 278, 21
FINAL_BASE, FINALS = 299, 28
SENTINEL_BASE, SENTINELS = 327, 57
SIZE = 384
FIRST_SYLLABLE, LAST_SYLLABLE = 0xAC00, 0xD7A3
PAD_TOKEN, EOS_TOKEN, UNK_TOKEN = "<pad>", "</s>", "<unk>"


def sentinel_token(k: int) -> str:
    return f"<extra_id_{k}>"


def special_tokens(sentinels: int = SENTINELS) -> dict[str, int]:
    """Literal token -> id, sentinels included."""
    named = {PAD_TOKEN: PAD, EOS_TOKEN: EOS, UNK_TOKEN: UNK}
    return named | {sentinel_token(k): SENTINEL_BASE + k for k in range(sentinels)}


def code_point_char(code: Column) -> Column:
    """The character of a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def vocabulary_table(spark: SparkSession, sentinels: int = SENTINELS) -> DataFrame:
    """(id, token, kind), 384 rows unless ``sentinels`` says otherwise: small enough to broadcast."""
    i = F.col("id")
    kind = (
        F.when(i < BYTE_BASE, "control")
        .when(i < INITIAL_BASE, "byte")
        .when(i < VOWEL_BASE, "initial")
        .when(i < FINAL_BASE, "vowel")
        .when(i < SENTINEL_BASE, "final")
        .otherwise("sentinel")
    )
    token = (
        F.when(i == PAD, PAD_TOKEN)
        .when(i == EOS, EOS_TOKEN)
        .when(i == UNK, UNK_TOKEN)
        .when(i < SENTINEL_BASE, code_point_char(i - BYTE_BASE))
        .otherwise(F.concat(F.lit("<extra_id_"), (i - SENTINEL_BASE).cast("string"), F.lit(">")))
    )
    return spark.range(SENTINEL_BASE + sentinels).select(i.cast("int").alias("id"), token.alias("token"), kind.alias("kind"))


def token_id(token: Column) -> Column:
    """Id of one token; a token of several characters that is not in the table is unknown."""
    sentinel = F.regexp_extract(token, "^<extra_id_(0|[1-9][0-9]?)>$", 1)
    return (
        F.when(token == PAD_TOKEN, PAD)
        .when(token == EOS_TOKEN, EOS)
        .when(token == UNK_TOKEN, UNK)
        .when(
            (sentinel != "") & (sentinel.try_cast("int") < SENTINELS),
            sentinel.try_cast("int") + SENTINEL_BASE,
        )
        .when(F.char_length(token) != 1, UNK)
        .otherwise(F.ascii(token) + BYTE_BASE)
    )
