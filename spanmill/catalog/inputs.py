"""Inputs that the registered queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.encode import letter_ids
from spanmill.functions.spans import span_lengths
from spanmill.operators.corpus import split_segments
from spanmill.operators.numbering import with_file_position
from spanmill.sources.readers import spread

LATIN = "abcdefghijklmnopqrstuvwxyz"
# Each Latin letter stands for one syllable, spread over the whole block.
SYLLABLES = "".join(chr(44032 + (i * 431) % 11172) for i in range(len(LATIN)))
SEGMENT = span_lengths()[0]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def shared_out(df: DataFrame, *keys: str) -> DataFrame:
    """On one machine, the rows of a table that is a single row group, over its cores."""
    context = df.sparkSession.sparkContext
    one_machine = context.master.startswith("local[") and df.rdd.getNumPartitions() < context.defaultParallelism
    return spread(df, *keys, tasks=context.defaultParallelism if one_machine else None)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, lang), shared out over the cores for the work that follows."""
    return shared_out(documents(spark, sf).select("doc_id", "text", "lang"), "doc_id")


def korean(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`texts`, with the Korean-looking text."""
    return shared_out(documents(spark, sf).select("doc_id", hangul().alias("text"), "lang"), "doc_id")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return with_file_position(documents(spark, sf))


def numbered_korean(spark: SparkSession, sf: str) -> DataFrame:
    """(record_no, text), numbered before the text is made Korean-looking."""
    docs = shared_out(numbered(spark, sf).select("record_no", "text"), "record_no")
    return docs.select("record_no", hangul().alias("text"))


def hangul(text: Column | str = "text") -> Column:
    """A Korean-looking text: Latin letters become syllables, the rest stays."""
    return F.translate(F.lower(text), LATIN, SYLLABLES)


def with_specials(text: Column | str = "text") -> Column:
    """The text with sentinels in place of commas, and control tokens at its end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.replace(text, F.lit(", "), F.lit("<extra_id_7>")), F.lit("<extra_id_57><<pad><unk></s>"))


def document_segments(spark: SparkSession, sf: str, pack: bool = False) -> DataFrame:
    """Segments of the Korean-looking documents, each document on its own."""
    ids = korean(spark, sf).select("doc_id", letter_ids("text", pack).alias("ids"))
    return split_segments(ids, "ids", SEGMENT, ["doc_id"])


def problems(spark: SparkSession, sf: str) -> DataFrame:
    """Math problems over lineitem: four right forms, some in other spellings, one wrong, one broken."""
    form = F.col("l_linenumber") % 6
    q, p = F.col("q"), F.col("p")
    rows = shared_out(table(spark, sf, "lineitem"), "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.col("l_quantity").cast("bigint").alias("q"),
        (F.col("l_partkey") % 97 + 1).alias("p"),
    )
    whole = lambda c: c.cast("string")
    scaled = F.expr("q * 10000 div p")
    ratio = F.concat(
        whole(F.expr("q * 10000 div p div 10000")), F.lit("."), F.lpad(whole(scaled % 10000), 4, "0")
    )
    share = F.concat(whole(F.expr("q * p div 100")), F.lit("."), F.lpad(whole(q * p % 100), 2, "0"))
    # Products in four spellings: plain, with powers, with a root of a large power, and as a sum of 2,001 terms.
    product = (
        F.when(p == 97, F.concat(q, F.lit("*"), p, F.repeat(F.lit("+1-1"), 1000)))
        .when(p % 3 == 1, F.concat(q, F.lit("^2*"), p, F.lit("/"), q, F.lit("^1")))
        .when(p % 3 == 2, F.concat(q, F.lit("*"), p, F.lit("*1^70000+(2^2000)^0.5/2^1000-1")))
        .otherwise(F.concat(q, F.lit("*"), p))
    )
    equation = (
        F.when(form == 0, F.concat(F.lit("x="), product))
        .when(form == 1, F.concat(F.lit("x="), q, F.lit(":"), p))
        .when(form == 2, F.concat(F.lit("x="), q, F.lit("(1/"), p, F.lit(")")))
        .when(form == 3, F.concat(F.lit("x="), p, F.lit("%*"), q))
        .when(form == 4, F.concat(F.lit("x="), q, F.lit("+"), p))
        .otherwise(F.concat(F.lit("x="), q, F.lit("+*"), p))
    )
    answer = (
        F.when(form == 0, whole(q * p))
        .when(form == 1, ratio)
        .when(form == 2, F.concat(q, F.lit("(1/"), p, F.lit(")")))
        .when((form == 3) & (p % 2 == 0), F.concat(q * p, F.lit("e-2")))
        .when(form == 3, share)
        .when(form == 4, whole(q + p + 1))
        .otherwise(whole(q))
    )
    text = F.concat(F.lit("It's "), q, F.lit(' and "None" '), p)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        text.alias("original_text_kr"),
        equation.alias("equation"),
        answer.alias("ans"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One decoded prediction per part: right, off by one or broken."""
    size, key = F.col("p_size"), F.col("p_partkey")
    answer = F.concat(
        size,
        F.lit("*"),
        key,
        F.when(key % 10 < 3, "+1").when(key % 10 == 3, "+").otherwise(""),
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("<pad> "), answer, F.lit("</s>"), F.repeat(F.lit("<pad>"), size % 3)).alias("decoded")
    )


def prediction_targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.concat("p_size", F.lit("*"), "p_partkey").alias("target_text")
    )


def literal_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Problems as Python dict literals, every line of an eighth order key broken."""
    whole = F.col("ans").rlike("^[0-9]+$")
    answer = F.when(whole, F.col("ans")).otherwise(F.concat(F.lit("'"), "ans", F.lit("'")))
    line = F.concat(
        F.lit("{'id': '"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("', 'original_text_kr': 'It\\'s None', "),
        F.lit("'hint': None, 'equation': \""), "equation", F.lit("\", 'ans': "), answer, F.lit("}"),
    )
    bad = F.concat(F.lit("bad "), "l_orderkey", F.lit("-"), "l_linenumber")
    return problems(spark, sf).select(F.when(F.col("l_orderkey") % 8 == 0, bad).otherwise(line).alias("value"))


def odd_literals(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`literal_lines`, with tuples, nested containers, adjacent strings, prefixes and escapes."""
    line = F.concat(
        F.lit("{'id': ("), "l_orderkey", F.lit(", "), "l_linenumber", F.lit("), 'question': 'It' \"'s\" ' \\x41\\t\\u00e9' r'\\n', "),
        F.lit("'steps': [True, {'equation': ('"), "equation", F.lit("'), 'more': ((), [None, {1, 2}], b'x')}], 'ans': '"), "ans", F.lit("',}"),
    )
    bad = F.concat(F.lit("{'id': ("), "l_orderkey", F.lit(", "), "l_linenumber", F.lit("), 'call': f()}"))
    return problems(spark, sf).select(F.when(F.col("l_orderkey") % 8 == 0, bad).otherwise(line).alias("value"))


def shaped_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON lines of three shapes; ``use`` names a place of the record itself."""
    made = F.col("doc_id") % 3
    whole = lambda *c: F.to_json(F.struct(F.col("doc_id").alias("id"), *c))
    return documents(spark, sf).select(
        F.when(made == 0, whole("text", F.lit("$.text").alias("use")))
        .when(made == 1, whole(F.struct(F.col("text").alias("body"), "lang").alias("content"), F.lit("$.content.lang").alias("use")))
        .otherwise(whole(F.array("source", "text").alias("parts"), F.lit("$.parts[0]").alias("use")))
        .alias("value")
    )
