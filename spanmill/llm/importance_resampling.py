"""Target-distribution importance resampling: documents are drawn by how much their word runs resemble a target corpus.

Runs of one and two words are hashed into ``BUCKETS`` buckets. A bucket's gain is the logarithm of its share in the target
over its share in the corpus, as whole thousandths; a document's weight is the mean gain of its runs, taken from one array
of gains. Weight plus a seeded Gumbel draw is the score, and the documents with the highest scores are drawn.

Ranks come from parallel sorting by regular sampling. Documents are sorted locally in at most ``RUNS`` runs; every run gives
as many samples at regular places; regular places among all samples are the splitters; each run is cut at the splitters,
segment k goes to task k, is merged there, and the counts of the segments before it give exact ranks. Every row has a
place of its own in the order (equal rows by run and place), so copies that hold a third of the rows are split, too.

Texts are read twice, for the corpus counts and for the weights, and never shuffled. The driver sees ``BUCKETS`` counts of each
corpus and ``2 * RUNS`` samples of each of ``RUNS`` runs at most.

Defined cases: null texts have no words, no runs and weight 0. A null id counts as an empty one in the draw and comes
after all others among equal scores. Repeated rows are drawn one by one. Equal scores and ids are ordered by the number of
runs. Long texts are read in pieces. Other columns are not read. An empty corpus has an empty result, an empty target
gives every bucket its share of an even one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import arrow_schema, slices, text_of, word_table, worded
from spanmill.session import written

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
RUNS = 512
SLICE = 2 << 20
#: Words whose runs are hashed at a time.
HELD = 1 << 19

#: Bytes of words are letters, digits and whatever is not ASCII.
WORD_BYTES = word_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def features(words: list[bytes], owner: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of one and two words, and the document of each. The first ``old`` words only lead on."""
    codes = pa.array(words, pa.binary()).dictionary_encode()
    known, at = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int64)
    single = [zlib.crc32(w) for w in known]
    spaced = [b" " + w for w in known]
    same = owner[:-1] == owner[1:]
    pairs = pa.array((at[:-1] * len(known) + at[1:])[same]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), len(known))
    double = [zlib.crc32(spaced[b], single[a]) for a, b in zip(left.tolist(), right.tolist())]
    ones = (np.array(single, np.int64) % BUCKETS)[at[old:]]
    twos = (np.array(double, np.int64) % BUCKETS)[pairs.indices.to_numpy()]
    return np.concatenate([ones, twos]), np.concatenate([owner[old:], owner[1:][same]])


def featured(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of runs, the text of each run, and the text of each word; about ``HELD`` words at a time."""
    words: list[bytes] = []
    owner: list[int] = []
    old = 0
    for k, data in enumerate(texts):
        for some in worded(data, WORD_BYTES):
            words += some
            owner += [k] * len(some)
            if len(words) >= HELD:
                place = np.array(owner, np.int64)
                yield *features(words, place, old), place[old:]
                words, owner, old = words[-1:], owner[-1:], 1
    place = np.array(owner, np.int64)
    yield *features(words, place, old), place[old:]


def histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many runs of all documents fall into each bucket. The driver gets ``BUCKETS`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, 0, SLICE):
            for buckets, _, _ in featured(part.column(0).to_pylist()):
                sums += np.bincount(buckets, minlength=BUCKETS)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there])], names=["bucket", "n"])

    found = docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint")
    sums = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the corpus, counts plus one."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * all_s) / ((s + 1.0) * all_t))) for s, t in pairs], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""
    schema = arrow_schema("doc_id bigint, n_words bigint, n_features bigint, weight bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            words, runs, sums = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for buckets, owner, place in featured(part.column(1).to_pylist()):
                np.add.at(words, place, 1)
                np.add.at(runs, owner, 1)
                np.add.at(sums, owner, gain[buckets])
            weight = sums // np.maximum(runs, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(runs), pa.array(weight)], schema=schema)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """A draw of each id in whole thousandths, from a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def order() -> list[Column]:
    """The order of ranks; the last two give every row a place of its own."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("run"), F.asc("at")]


def sort_keys(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The order of :func:`order` for ``numpy.lexsort``, last key first."""
    return rows["at"], rows["run"], rows["n_features"], rows["doc_id"], rows["unnamed"], -rows["score"]


def key_columns(batch: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    ids = batch.column("doc_id")
    plain = {c: batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy()
             for c in ("score", "n_features", "run", "at")}
    named = ids.fill_null(0)
    named = named.to_numpy() if isinstance(batch, pa.Table) else named.to_numpy(zero_copy_only=False)
    return plain | {"doc_id": named, "unnamed": np.asarray(ids.is_null()).astype(np.int8)}


def splitters(runs: DataFrame, segments: int) -> dict[str, np.ndarray]:
    """At most ``segments - 1`` rows of the runs that cut all rows into nearly even segments.

    Every run gives its row at each of about ``segments`` regular places, and each sample stands for the rows up to it.
    """
    sizes = runs.groupBy("run").agg(F.count("*").alias("rows"))
    step = F.greatest(F.lit(1), F.expr(f"rows div {segments}")).alias("step")
    sampled = runs.join(F.broadcast(sizes.select("run", step)), "run").where("(at + 1) % step = 0")  # RUNS rows at most
    rows = sampled.select("score", "n_features", "run", "at", "doc_id", "step").toArrow()
    keys = key_columns(rows)
    by = np.lexsort(sort_keys(keys))
    upto = np.cumsum(rows.column("step").to_numpy()[by])
    if not len(upto):
        return keys
    wanted = upto[-1] * np.arange(1, segments) // segments
    chosen = np.unique(np.minimum(np.searchsorted(upto, wanted), len(upto) - 1))
    return {c: v[by[chosen]] for c, v in keys.items()}


def ranked(rows: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for rows with the first four of these: ranks from 1 in :func:`order`."""
    spark = rows.sparkSession
    segments = min(RUNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    local = rows.coalesce(segments).sortWithinPartitions(*order()[:3])
    runs = written(local.select("*", F.spark_partition_id().cast("bigint").alias("run"), at.alias("at")), "runs")
    cuts = splitters(runs, segments)
    n_cuts = len(cuts["at"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = key_columns(batch)
            by = np.lexsort(sort_keys({c: np.concatenate([cuts[c], own[c]]) for c in own}))
            segment = np.empty(len(by), np.int32)
            segment[by] = np.cumsum(by < n_cuts)
            # A splitter ends its segment, so the row that became one stands before the cut.
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[n_cuts:])], names=[*batch.schema.names, "segment"])

    dealt = runs.mapInArrow(deal, runs.schema.simpleString()[7:-1].replace(":", " ") + ", segment int")
    merged = dealt.repartitionById(segments, F.col("segment")).sortWithinPartitions(*order())
    columns = ["doc_id", "n_features", "weight", "score", "segment"]
    merged = written(merged.select(*columns, at.alias("place")), "segments")
    sizes = {r["segment"]: r["n"] for r in merged.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # RUNS rows at most
    first = [0]
    for k in range(segments):
        first.append(first[-1] + sizes.get(k, 0))
    before = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in first]), F.col("segment") + 1)
    return merged.select(*columns[:4], (before + F.col("place") + 1).alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    ``percent`` of the documents with ``min_words`` words are drawn, those with the highest scores.
    """
    gain = gains(histogram(docs, text), histogram(target, target_text))
    scored = weighted(docs, gain, doc_id, text).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = written(scored, "scored")
    columns = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= min_words)
    quota = percent * able.count() // 100
    found = ranked(able.select(*columns))
    found = found.select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    return found.union(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("bigint")))
