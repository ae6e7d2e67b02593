"""Token counts kept up to date by deltas: totals by source, language and tokenizer version.

A batch of changes says of documents that they are inserted, deleted, or counted anew. It becomes signed rows: what the
ledger holds of the document is taken back, the new count is added. The sums of the signed rows by source, language and
tokenizer are the batch's delta, and the totals are the sums of all deltas: additive, and never computed from all
documents again.

A batch is committed once. Its rows are written to a folder of its own, which a repeated attempt overwrites, and it counts
from the moment its id is in the table of commits; committing the same id again does nothing. A batch that failed halfway
is not in that table and is never read.

Defined cases: an insert of a document that is there replaces it; a delete or a new count of one that is not there deletes
nothing or inserts. Null ids are changes of one document without id, null counts are zero. If a batch changes a document
and tokenizer more than once, the row with the highest ``seq`` counts (ties: the greatest of op, source, lang, n_tokens).
A null source or language is a group of its own. An empty batch commits with an empty delta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGES = "seq bigint, op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
LEDGER = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, sign int"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]

#: Two tokenizers that SQL can express too; any count may be used instead.
TOKENIZERS = {"words-1": r"[^ \t\r\n]+", "pieces-1": r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\r\n]"}


def counted(docs: DataFrame, op: str, seq: int, tokenizers: dict[str, str] = TOKENIZERS, text: str = "text") -> DataFrame:
    """``CHANGES`` for documents with doc_id, source, lang and a text: one row for each tokenizer, in one pass."""
    counts = F.array(*[
        F.struct(F.lit(name).alias("tokenizer"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern)).alias("n"))
        for name, pattern in tokenizers.items()
    ])
    rows = docs.select("doc_id", "source", "lang", F.explode(counts).alias("c"))
    return rows.select(
        F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("c.tokenizer").alias("tokenizer"), F.col("c.n").cast("bigint").alias("n_tokens"),
    )


def removed(docs: DataFrame, seq: int, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """``CHANGES`` that delete documents; their texts are not read."""
    name = F.explode(F.array(*[F.lit(t) for t in tokenizers])).alias("tokenizer")
    return docs.select(
        F.lit(seq).cast("bigint").alias("seq"), F.lit("delete").alias("op"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), name,
        F.lit(None).cast("bigint").alias("n_tokens"),
    )


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], "batch bigint").write.mode("ignore").parquet(f"{folder}/commits")

    def committed(self) -> list[int]:
        return sorted(r["batch"] for r in self.spark.read.schema("batch bigint").parquet(f"{self.folder}/commits").distinct().collect())

    def _read(self, part: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{part}/{b}" for b in batches])

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; false if it was applied before."""
        before = self.committed()
        if batch in before:
            return False
        last = Window.partitionBy(*KEY).orderBy(F.desc("seq"), *(F.desc_nulls_last(c) for c in ("op", "source", "lang", "n_tokens")))
        now = changes.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "seq")
        now = now.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("bigint"))
        one = F.lit(1).alias("sign")
        added = now.where("op <> 'delete'").select("doc_id", *GROUP, "n_tokens", one)
        signed = added
        if before:
            held = self._read("ledger", LEDGER, before)
            touched = now.select(*[F.col(c).alias(f"_{c}") for c in KEY])
            same = F.lit(True)
            for c in KEY:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            held = held.join(touched, same, "left_semi").groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("sign"))
            back = held.where("sign > 0").select("doc_id", *GROUP, "n_tokens", F.lit(-1).alias("sign"))
            signed = back.union(added)
        signed.write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch}")
        rows = self._read("ledger", LEDGER, [batch])
        self._sums(rows, F.col("sign"), F.col("sign") * F.col("n_tokens")).write.mode("overwrite").parquet(f"{self.folder}/delta/{batch}")
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    @staticmethod
    def _sums(rows: DataFrame, docs: Column, tokens: Column) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """``DELTA``: the sums of all committed deltas, without groups that hold no document any more."""
        return self._sums(self._read("delta", DELTA, self.committed()), F.col("n_docs"), F.col("n_tokens")).where("n_docs <> 0")
