"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.numbering import with_line_position

CORRUPT = "_corrupt_record"
PROBLEM_SCHEMA = f"original_text_kr string, equation string, ans string, {CORRUPT} string"
TRIPLE_SCHEMA = "prefix string, input_text string, target_text string"
MISSING = "nan"  # fixed value: how a missing TSV field reads as text
# What pandas takes for a missing field.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)

# A quoted string with its escapes, a run without quotes, or a quote that nothing closes.
LITERAL_PIECES = r"""('(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^'"]++|['"])"""


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Share out the rows of a scan of few files over ``tasks``; nothing moves unless that is asked for.

    One gzip file or one Parquet row group is one task whatever follows.
    """
    return df if tasks is None else df.repartition(tasks, *keys)


def read_jsonl_shards(
    spark: SparkSession, paths: str | list[str], schema: str = "text string", record_no: str | None = "record_no"
) -> DataFrame:
    """JSON-line shards (gzip or plain) in sorted file order, one row per line.

    Lines are parsed after they are numbered, so the number of a record does
    not depend on which fields a query uses. A line that is no JSON object is
    kept in the ``_corrupt_record`` column, if ``schema`` names it.
    """
    lines = spark.read.text(paths)
    if record_no is not None:
        lines = with_line_position(lines, record_no)
    numbered = [record_no] if record_no is not None else []
    return (
        lines.where(F.trim("value") != "")
        .select(*numbered, F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("_r"))
        .select(*numbered, "_r.*")
    )


def python_literal_json(line: Column) -> Column:
    """A Python dict literal as JSON: None, True and False outside quotes are renamed."""

    def piece_json(piece: Column) -> Column:
        renamed = piece
        for literal, name in (("None", "null"), ("True", "true"), ("False", "false")):
            renamed = F.regexp_replace(renamed, rf"\b{literal}\b", name)
        return F.when(piece.rlike("""^['"]"""), piece).otherwise(renamed)

    pieces = F.regexp_extract_all(line, F.lit(LITERAL_PIECES), F.lit(1))
    return F.array_join(F.transform(pieces, piece_json), "")


def read_literal_lines(
    spark: SparkSession, paths: str | list[str], schema: str = PROBLEM_SCHEMA, corrupt: str = CORRUPT
) -> DataFrame:
    """One Python dict literal per line; a line that is not one lands in the ``corrupt`` column."""
    options = {
        "allowSingleQuotes": "true",
        "allowBackslashEscapingAnyCharacter": "true",
        "columnNameOfCorruptRecord": corrupt,
        "mode": "PERMISSIVE",
    }
    parsed = F.from_json(python_literal_json(F.col("value")), schema, options)
    return spark.read.text(paths).where(F.trim("value") != "").select(parsed.alias("_r")).select("_r.*")


def read_tsv(
    spark: SparkSession,
    paths: str | list[str],
    schema: str = TRIPLE_SCHEMA,
    missing: str | None = MISSING,
    line_ends: bool = True,
    missing_words: tuple[str, ...] = MISSING_WORDS,
) -> DataFrame:
    """TSV with a header, every column text; a missing or empty field or a word for one as ``missing``.

    ``line_ends`` allows quoted fields to hold line ends, and a file is then one
    task; without it a large file is split.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", line_ends)
        .csv(paths)
    )
    if missing is None:
        return df
    text = lambda c: F.col(c).cast("string")
    known = lambda c: F.when(~text(c).isin(*missing_words), text(c))
    return df.select(*[F.coalesce(known(c), F.lit(missing)).alias(c) for c in df.columns])


def read_named_split(spark: SparkSession, root: str, lang: str, split: str, schema: str | None = None) -> DataFrame:
    """One language and split of a catalogue laid out as ``lang=/split=`` folders."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(root).where((F.col("lang") == lang) & (F.col("split") == split))


def union_files(*parts: DataFrame) -> DataFrame:
    """Files of one schema, appended."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def zip_text_labels(texts: DataFrame, labels: DataFrame, key: str, label: str, unlabelled: bool = False) -> DataFrame:
    """Texts with their labels, matched by key and never by position.

    Without a label a text is no training example and is left out, unless ``unlabelled`` asks for it with a null label.
    """
    return texts.join(labels.select(key, F.col(label).alias("label")), key, "left" if unlabelled else "inner")
