"""The corpus pipeline: raw documents to token counts and digests, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is all that the stage before it kept, and returns a DataFrame. It
is written as Parquet to the shared folder and read again as the next stage's documents. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import byte_bpe, decontamination, language_id, secret_scan, simhash
from spanmill.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or with a narrow margin go."""
    return language_id.accepted(docs, language_id.learned(docs))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.first_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark passage."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no rule finds a secret."""
    return secret_scan.without_secrets(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts: how many, their digest, and the digest of what they decode to."""
    keys = [F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string")]
    return byte_bpe.encoded(docs, keys, "doc_id bigint, lang string, source string", with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", first_of_near_copies),
    ("decontamination", uncontaminated),
    ("secret_scan", without_secrets),
    ("byte_bpe", tokenized),
]

#: SQL has neither zstandard nor XXH64 nor BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
