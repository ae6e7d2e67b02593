"""One query per operator, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.catalog import inputs as I
from spanmill.functions import cleaning as C
from spanmill.functions import sequences as Q
from spanmill.functions import spans as S
from spanmill.functions.binding import bind
from spanmill.functions.decode import decode_ids
from spanmill.functions.encode import byte_ids, first_ids, letter_ids, special_letter_ids
from spanmill.operators import corpus as K
from spanmill.operators import equations as E
from spanmill.operators import metrics as M
from spanmill.operators import mixing as X
from spanmill.operators import projection as P
from spanmill.operators import records as D
from spanmill.operators import splitting as L
from spanmill.operators.vocabulary_use import vocabulary_use
from spanmill.operators.corruption import corrupt, with_noise_spans
from spanmill.operators.numbering import with_line_position, with_shuffled_position
from spanmill.operators import length_packing as H
from spanmill.operators import packing as Z
from spanmill.plans import jobs
from spanmill.plans.recipes import Registry, registry, run_together
from spanmill.plans.tables import register_tables
from spanmill.session import scratch, written
from spanmill.sources import line_index as N
from spanmill.sources import literals as V
from spanmill.sources import readers as R
from spanmill.sources import sinks as W
from spanmill.sources.token_cache import TokenCache
from spanmill.streaming import epochs as O
from spanmill.streaming import jobs as T
from spanmill.streaming import shuffle as U

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """Id arrays as text, so that results compare by value."""
    return df.select(*[Q.ids_text(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


# Sources and sinks


@query
def src_jsonl_shards(spark, sf):
    path = scratch(spark, "shards")
    rows = I.documents(spark, sf).select("doc_id", "text")
    W.write_jsonl_shards(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    return R.read_jsonl_shards(spark, path, "doc_id bigint, text string")


@query
def src_records_by_number(spark, sf):
    """Every record of the shards, half of them compressed, fetched by its number with a sparse index of their lines."""
    path = scratch(spark, "shards")
    rows = I.documents(spark, sf).select("doc_id", "text")
    middle = rows.agg(F.expr("percentile_approx(doc_id, 0.5)").alias("m")).first()["m"]
    for name, part, packed in (("a", rows.where(F.col("doc_id") <= middle), "gzip"), ("b", rows.where(F.col("doc_id") > middle), "none")):
        ordered = part.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        ordered.write.option("compression", packed).json(f"{path}/{name}")
    index = written(N.line_index(spark, [f"{path}/a", f"{path}/b"], every=64), "line-index")
    total = index.agg(F.sum("lines").alias("n")).first()["n"] or 0
    found = N.lines_at(index, spark.range(total).toDF("number"))
    return found.select("number", F.from_json("value", "doc_id bigint, text string").alias("r")).select("number", "r.*")


@query
def src_literal_lines(spark, sf):
    path = scratch(spark, "literals")
    I.literal_lines(spark, sf).write.text(path)
    df = R.read_literal_lines(spark, path, f"id string, {R.PROBLEM_SCHEMA}")
    return df.select("id", "original_text_kr", "equation", "ans", F.col(R.CORRUPT).alias("bad_line"))


@query
def src_literal_records(spark, sf):
    """Problems as Python literals with tuples, nested containers, adjacent strings and escapes, every eighth order broken."""
    path = scratch(spark, "literals")
    I.odd_literals(spark, sf).write.text(path)
    read = V.read_literal_records(spark, path)
    part = lambda key, kind="string": D.value_at("record", key, kind=kind)
    return read.select(
        part("$.id[0]", "bigint").alias("l_orderkey"), part("$.id[1]", "int").alias("l_linenumber"), part("$.question").alias("question"),
        part("$.steps[1].equation").alias("equation"), part("$.steps[0]", "boolean").alias("first"), part("$.ans").alias("ans"), "bad_line",
    )


@query
def src_union_files(spark, sf):
    first, second = scratch(spark, "first"), scratch(spark, "second")
    W.write_jsonl_shards(I.documents(spark, sf).select(F.col("doc_id").alias("id"), "text"), first)
    W.write_jsonl_shards(I.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), second)
    return R.read_jsonl_shards(spark, [first, second], "id bigint, text string", record_no=None)


@query
def src_tsv_as_str(spark, sf):
    path = scratch(spark, "tsv")
    words = F.element_at(F.array(*[F.lit(w) for w in ("NA", "None", "null", "N/A")]), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 10 > 1, F.col("text")).when(F.col("doc_id") % 10 == 1, words)
    W.write_tsv(I.documents(spark, sf).select(F.col("doc_id").alias("prefix"), text.alias("input_text"), F.col("lang").alias("target_text")), path)
    return R.read_tsv(spark, path)


@query
def src_named_splits(spark, sf):
    path = scratch(spark, "splits")
    W.write_named_splits(L.split_fraction(I.documents(spark, sf), ["doc_id"], 90), path)
    return R.read_named_split(spark, path, "en", "train").select("doc_id", "text", "lang", "split")


@query
def src_text_label_zip(spark, sf):
    return R.zip_text_labels(
        I.documents(spark, sf).select("doc_id", "text"), I.table(spark, sf, "labels"), "doc_id", "quality", unlabelled=True
    )


@query
def sink_tsv(spark, sf):
    path = scratch(spark, "tsv")
    awkward = F.concat(F.lit(" \t\\"), "text", F.lit('"\n\\\t "" '))
    W.write_tsv(
        I.documents(spark, sf).select(F.col("doc_id").alias("prefix"), awkward.alias("input_text"), F.col("source").alias("target_text")), path
    )
    return R.read_tsv(spark, path)


@query
def sink_predictions_text(spark, sf):
    path = scratch(spark, "predictions")
    decoded = F.concat(F.lit("<pad>"), "text", F.lit("<pad><pad>"))
    df = I.documents(spark, sf).select("doc_id", C.strip_trailing_pad(decoded).alias("prediction"))
    W.write_predictions(df, path, "doc_id", "prediction")
    return with_line_position(spark.read.text(path))


@query
def sink_token_cache(spark, sf):
    path = scratch(spark, "tokens")
    ids = I.korean(spark, sf).select("doc_id", letter_ids("text").alias("ids"))
    W.write_token_cache(ids, path, "letters", "train")
    return text_of(W.read_token_cache(spark, path, "letters", "train"), "ids")


# Split, sample, mix, order


@query
def sink_cached_tokens(spark, sf):
    """Token ids from a cache that is asked twice and built once."""
    cache, built = TokenCache(spark, scratch(spark, "cache")), []

    def build(docs):
        built.append(1)
        return docs.select("doc_id", Q.ids_text(letter_ids("text")).alias("ids"))

    for _ in range(2):
        found = cache.cached(I.documents(spark, sf), "letters", build, {"length": None})
    return found.withColumn("builds", F.lit(len(built)))


@query
def split_every_nth(spark, sf):
    return L.split_every_nth(I.numbered(spark, sf)).select("doc_id", "record_no", "split")


@query
def limit_cap(spark, sf):
    return L.limit_cap(I.table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_id"])


@query
def split_fraction(spark, sf):
    return L.split_fraction(I.documents(spark, sf).select("doc_id"), ["doc_id"])


@query
def sample_bernoulli(spark, sf):
    return L.sample_bernoulli(I.documents(spark, sf).select("doc_id", "text"), ["doc_id"])


@query
def mix_fixed_rates(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", "lang")
    total = docs.agg(F.count("*").alias("n")).scalar()
    return X.mix_fixed_rates(docs, "lang", ["doc_id"], {"fr": 0.7, "en": 0.3}, total)


RATE_ORDER = {"fr": 5, "en": 3, "de": 2}


@query
def mix_rate_order(spark, sf):
    """As many examples as there are documents, in an order of which every prefix keeps the rates."""
    docs = I.documents(spark, sf).select("doc_id", "lang")
    return X.mix_in_rate_order(docs, "lang", ["doc_id"], RATE_ORDER, docs.count())


@query
def mix_temperature_rates(spark, sf):
    rates = X.temperature_rates(I.documents(spark, sf), "lang")
    return rates.select("lang", "n", F.round("rate", 9).alias("rate"))


@query
def shuffle_seeded(spark, sf):
    return X.shuffle_seeded(I.documents(spark, sf).select("doc_id", "text"), ["doc_id"])


@query
def repeat_epochs(spark, sf):
    return X.repeat_epochs(I.documents(spark, sf).select("doc_id"), ["doc_id"], 3)


@query
def batch_assign(spark, sf):
    return X.batch_assign(I.numbered(spark, sf), "record_no", 16, drop_last=True).select("doc_id", "batch_id", "slot")


@query
def batch_plan(spark, sf):
    return X.batch_plan(I.documents(spark, sf), batch=8, gpus=2, accumulate=4, epochs=5)


# Projections, filters, joins


@query
def rekey(spark, sf):
    return P.rekey(I.documents(spark, sf), {"inputs": None, "targets": "text"}, keep=["doc_id"])


@query
def rekey_records(spark, sf):
    """Features of JSON lines of three shapes, the key of one feature named by the record itself."""
    path = scratch(spark, "shapes")
    I.shaped_records(spark, sf).write.text(path)
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("record"))
    own = F.try_variant_get("record", "$.use", "string")
    keys = {"inputs": None, "targets": ["$.text", "$.content.body", "$.parts[1]"], "chosen": own, "doc_id": "$.id"}
    return D.rekey_records(lines, "record", keys)


@query
def select_features(spark, sf):
    keyed = P.rekey(I.documents(spark, sf), {"inputs": None, "targets": "text", "raw": "source"}, keep=["doc_id"])
    return P.select_features(keyed, ["inputs", "targets", "weights"], keep=["doc_id"])


@query
def project_task_triple(spark, sf):
    return P.project_task_triple(I.problems(spark, sf), "original_text_kr", "equation", keep=["l_orderkey", "l_linenumber"])


@query
def prompt_concat(spark, sf):
    text = F.when(F.col("doc_id") % 10 > 0, F.col("text"))
    return I.documents(spark, sf).select("doc_id", P.prompt(F.col("lang"), text).alias("prompt"))


@query
def filter_blacklist(spark, sf):
    judged = E.verify_equations(I.problems(spark, sf))
    return judged.where("verdict = 'right'").select("l_orderkey", "l_linenumber", "equation")


@query
def lookup_by_index(spark, sf):
    names = spark.createDataFrame(list(enumerate(jobs.LABEL_NAMES)), "id int, name string")
    docs = I.documents(spark, sf).select("doc_id", "lang")
    labels = I.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return P.with_label_text(P.lookup_by_key(docs, labels, ["doc_id"]), "label", names)


@query
def subset_by_verdict(spark, sf):
    scored = score_predictions(spark, sf)
    return P.keep_listed(I.prediction_targets(spark, sf), scored.where("verdict = 'wrong'"), ["p_partkey"])


@query
def flatten_batches(spark, sf):
    batched = X.batch_assign(I.numbered(spark, sf), "record_no", 16)
    members = F.array_sort(F.collect_list(F.struct("slot", "text")))
    batches = batched.groupBy("batch_id").agg(F.transform(members, lambda m: m["text"]).alias("texts"))
    return X.flatten_batches(batches, "batch_id", "texts", "text", size=16)


# Text cleaning


@query
def clean_review_text(spark, sf):
    review = F.concat(F.lit(" \t"), "text", F.lit("<br/><br />a-b/c!<br/><br/> 　\n"))
    return I.documents(spark, sf).select("doc_id", C.clean_review_text(review).alias("text"))


@query
def normalize_equation(spark, sf):
    df = I.problems(spark, sf)
    text = F.concat("equation", F.lit("+5%-1"), "ans", F.lit("%"))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        C.normalize_equation(text).alias("plain"),
        C.normalize_equation(text, strict=True).alias("strict"),
    )


@query
def strip_target_prefix(spark, sf):
    both = F.concat("equation", F.lit("=x="), "equation")
    return I.problems(spark, sf).select("l_orderkey", "l_linenumber", C.strip_target_prefix(both).alias("target"))


@query
def clean_prediction(spark, sf):
    decoded = F.col("decoded")
    return I.predictions(spark, sf).select(
        "p_partkey",
        C.clean_prediction(decoded).alias("legacy"),
        C.clean_prediction(decoded, legacy=False).alias("by_name"),
        C.strip_trailing_pad(decoded).alias("unpadded"),
    )


# Tokenisation


@query
def tok_byte_encode(spark, sf):
    return text_of(I.texts(spark, sf).select("doc_id", byte_ids("text").alias("ids")), "ids")


@query
def tok_jamo_encode(spark, sf):
    return text_of(I.korean(spark, sf).select("doc_id", letter_ids("text").alias("ids")), "ids")


@query
def tok_special_encode(spark, sf):
    ids = special_letter_ids(I.with_specials())
    return text_of(I.korean(spark, sf).select("doc_id", ids.alias("ids")), "ids")


@query
def tok_vocab_table(spark, sf):
    """Use of each vocabulary entry in the corpus."""
    return vocabulary_use(I.korean(spark, sf).select(I.with_specials().alias("text")))


@query
def tok_append_eos(spark, sf):
    ids = byte_ids("text")
    given = F.when(F.col("doc_id") % 2 == 0, Q.append_eos_always(ids)).otherwise(ids)
    df = I.texts(spark, sf).select("doc_id", given.alias("given"))
    return text_of(
        df.select("doc_id", Q.append_eos(F.col("given")).alias("once"), Q.append_eos_always(F.col("given")).alias("always")),
        "once",
        "always",
    )


@query
def tok_trim_then_eos(spark, sf):
    ids = Q.append_eos_always(first_ids("text", S.INPUT_LENGTH - 1))
    return text_of(I.korean(spark, sf).select("doc_id", ids.alias("ids")), "ids")


@query
def tok_truncate(spark, sf):
    df = I.korean(spark, sf).select("doc_id", letter_ids("text").alias("ids"))
    return text_of(
        df.select(
            "doc_id",
            Q.truncate(F.col("ids"), I.SEGMENT).alias("corpus"),
            Q.truncate_ended(F.col("ids"), 512).alias("input"),
            Q.truncate_ended(F.col("ids"), 128).alias("target"),
        ),
        "corpus",
        "input",
        "target",
    )


@query
def tok_pair_inputs(spark, sf):
    """Each even turn with the turn after it; a last turn without one is a sequence of its own."""
    turns = I.table(spark, sf, "conversations")
    first = turns.where("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("a"))
    second = turns.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    df = first.join(second, ["conv_id", "turn"], "left").select("conv_id", "turn", letter_ids("a").alias("a"), letter_ids("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    return text_of(
        df.select(
            "conv_id",
            "turn",
            F.when(b.isNull(), Q.append_eos(a)).otherwise(Q.join_pair(a, b)).alias("ids"),
            F.when(b.isNull(), Q.single_special_mask(a)).otherwise(Q.pair_special_mask(a, b)).alias("special_mask"),
            F.when(b.isNull(), Q.single_type_ids(a)).otherwise(Q.pair_type_ids(a, b)).alias("type_ids"),
        ),
        "ids",
        "special_mask",
        "type_ids",
    )


def _padded_512(spark, sf):
    ids = Q.append_eos(first_ids("text", 511))
    df = I.korean(spark, sf).select("doc_id", ids.alias("ids"))
    return df.select("doc_id", Q.pad_to(F.col("ids"), 512).alias("ids"), Q.attention_mask(F.col("ids"), 512).alias("mask"))


@query
def pad_fixed(spark, sf):
    return text_of(_padded_512(spark, sf), "ids", "mask")


@query
def pad_batch_longest(spark, sf):
    """Width of a batch is known from byte counts, so ids are padded where they are made."""
    from pyspark.sql import Window

    docs = I.numbered(spark, sf).withColumn("text", I.hangul())
    length = F.least(F.octet_length("text"), F.lit(I.SEGMENT)).alias("length")
    short = docs.select("doc_id", "record_no", length, F.substring("text", 1, I.SEGMENT).alias("text"))  # before texts move
    batched = X.batch_assign(short, "record_no", 16)
    width = F.max("length").over(Window.partitionBy("batch_id"))
    df = batched.select("doc_id", "batch_id", "text", width.alias("width"))
    ids = F.col("ids")
    padded = df.select("doc_id", "batch_id", "width", first_ids("text", I.SEGMENT).alias("ids")).select(
        "doc_id", "batch_id", Q.pad_to(ids, F.col("width")).alias("ids"), Q.pad_to(ids, F.col("width"), Q.IGNORED_LABEL).alias("labels")
    )
    return text_of(padded, "ids", "labels")


@query
def mask_label_pad(spark, sf):
    """Whole texts, padded to the next multiple of 512 and the padding masked."""
    df = I.korean(spark, sf).select("doc_id", Q.append_eos(letter_ids("text")).alias("ids"))
    whole = bind(F.col("ids"), lambda v: Q.ignore_padding(Q.pad_to(v, (F.ceil(F.size(v) / 512) * 512).cast("int"))))
    return text_of(df.select("doc_id", whole.alias("labels")), "labels")


@query
def assemble_examples(spark, sf):
    short = I.documents(spark, sf).select("doc_id", F.substring("text", 1, 511).alias("text"))  # before texts move
    rows = R.zip_text_labels(short, I.table(spark, sf, "labels"), "doc_id", "quality")
    ids = rows.select(
        "doc_id",
        Q.append_eos(first_ids("text", 511)).alias("ids"),
        special_letter_ids(P.label_text(F.col("label"), jobs.LABEL_NAMES)).alias("target"),
    )
    return text_of(
        ids.select(
            "doc_id",
            Q.pad_to(F.col("ids"), 512).alias("input_ids"),
            Q.attention_mask(F.col("ids"), 512).alias("attention_mask"),
            Q.append_eos(F.col("target")).alias("labels"),
        ),
        "input_ids",
        "attention_mask",
        "labels",
    )


@query
def tok_decode(spark, sf):
    both = I.shared_out(I.documents(spark, sf).select("doc_id", "text", I.with_specials(I.hangul()).alias("special")), "doc_id")
    df = both.select("doc_id", special_letter_ids("special").alias("ids"), byte_ids("text").alias("raw"))
    return df.select("doc_id", decode_ids("ids").alias("text"), decode_ids("raw").alias("bytes_text"))


@query
def sentinel_remap(spark, sf):
    pairs = corrupt(_byte_segments(spark, sf), ["doc_id", "segment"], S.BYTES_ASCENDING)
    down = pairs.select("doc_id", "segment", "inputs", Q.sentinels_to_descending(F.col("inputs")).alias("down"))
    return text_of(down.select("*", Q.sentinels_to_ascending(F.col("down")).alias("up")), "inputs", "down", "up")


# Span corruption


def _byte_segments(spark, sf, pack=False):
    ids = I.texts(spark, sf).select("doc_id", byte_ids("text", pack).alias("ids"))
    return K.split_segments(ids, "ids", I.SEGMENT, ["doc_id"])


@query
def span_lengths(spark, sf):
    """Segments of each document and what its last one is corrupted to, planned from byte counts alone."""
    n = F.octet_length(I.hangul())
    tail = ((F.col("tokens") - 1) % I.SEGMENT + 1).cast("int")
    df = I.documents(spark, sf).select("doc_id", n.alias("tokens")).where("tokens > 0")
    planned = df.select("doc_id", "tokens", F.ceil(F.col("tokens") / I.SEGMENT).alias("segments"), tail.alias("tail"))
    inputs, targets = S.example_lengths(F.col("tail"))
    return planned.select("*", inputs.alias("tail_inputs"), targets.alias("tail_targets"))


@query
def span_target_guard(spark, sf):
    """Every segment's targets checked against the configured length while the job runs."""
    S.check_target_length(S.TARGET_LENGTH)
    pairs = corrupt(I.document_segments(spark, sf), ["doc_id", "segment"], S.LETTERS_ASCENDING)
    needed = F.size("targets")
    fits = F.assert_true(needed <= S.TARGET_LENGTH, "targets do not fit")
    return pairs.select("doc_id", "segment", needed.alias("needed"), fits.isNull().alias("fits"))


@query
def chunk_random_select(spark, sf):
    ids = I.korean(spark, sf).select("doc_id", letter_ids("text").alias("ids"))
    return text_of(K.random_chunk(ids, "ids", ["doc_id"], length=2048), "ids")


@query
def concat_tokens(spark, sf):
    ids = I.numbered(spark, sf).select("record_no", letter_ids(I.hangul(), squeeze=True).alias("ids"))
    return Q.spelled(K.concat_tokens(ids, "ids", "record_no"), ["ids"])


@query
def split_segments(spark, sf):
    return text_of(I.document_segments(spark, sf), "ids")


@query
def noise_spans(spark, sf):
    spanned = with_noise_spans(I.document_segments(spark, sf), ["doc_id", "segment"])
    return spanned.select("doc_id", "segment", F.explode("spans").alias("s")).select("doc_id", "segment", "s.at", "s.keep", "s.drop")


def _by_mask(spark, sf):
    spanned = with_noise_spans(I.document_segments(spark, sf), ["doc_id", "segment"])
    return spanned.withColumn("mask", S.spans_mask(F.col("spans")))


@query
def corrupt_inputs(spark, sf):
    df = _by_mask(spark, sf)
    inputs = S.corrupt_inputs(F.col("ids"), S.mask_spans(F.col("mask")), S.LETTERS_ASCENDING)
    return text_of(df.select("doc_id", "segment", inputs.alias("inputs")), "inputs")


@query
def corrupt_targets(spark, sf):
    df = _by_mask(spark, sf)
    targets = S.corrupt_targets(F.col("ids"), S.mask_spans(F.col("mask")), S.LETTERS_ASCENDING)
    return text_of(df.select("doc_id", "segment", targets.alias("targets")), "targets")


@query
def corrupt_pairs(spark, sf):
    pairs = registry.recipe("letters_ascending").run(I.numbered_korean(spark, sf))
    return text_of(pairs, "inputs", "targets")


@query
def sentinel_schemes(spark, sf):
    docs = I.numbered(spark, sf).select("record_no", "text")
    out = None
    for name, pairs in run_together(list(registry.recipes.values()), docs).items():
        pairs = pairs.select(F.lit(name).alias("scheme"), "*")
        out = pairs if out is None else out.unionByName(pairs)
    return text_of(out, "inputs", "targets")


def _packed(spark, sf, pack):
    pairs = corrupt(I.document_segments(spark, sf, pack=True), ["doc_id", "segment"], S.LETTERS_ASCENDING, pack=True)
    return Z.pack_or_pad(pairs, ["doc_id", "segment"], F.floor(F.col("doc_id") / 100), pack, packed_ids=True)


PACKED = [f"{side}{part}" for side in ("inputs", "targets") for part in ("", "_segmentation", "_position")]


@query
def pack_or_pad(spark, sf):
    return Q.spelled(_packed(spark, sf, True), PACKED)


@query
def pack_by_lengths(spark, sf):
    """Examples read back from packs that were made by the histogram of lengths: none is lost, and none cut."""
    pairs = corrupt(I.document_segments(spark, sf, pack=True), ["doc_id", "segment"], S.LETTERS_ASCENDING, pack=True)
    packs = H.pack_by_lengths(pairs, ["doc_id", "segment"], packed_ids=True)
    return Q.spelled(H.unpacked(packs, ["inputs", "targets"]), ["inputs", "targets"])


@query
def pad_without_packing(spark, sf):
    return Q.spelled(_packed(spark, sf, False), ["inputs", "targets"])


# Equation verification and evaluation


@query
def verify_equations(spark, sf):
    return E.verify_equations(I.problems(spark, sf)).select("l_orderkey", "l_linenumber", "equation", "ans", "verdict")


@query
def score_predictions(spark, sf):
    predicted = I.predictions(spark, sf).select("p_partkey", C.clean_prediction(F.col("decoded"), legacy=False).alias("predicted"))
    return E.score_predictions(predicted, I.prediction_targets(spark, sf), ["p_partkey"])


@query
def verdict_rates(spark, sf):
    rates = E.verdict_rates(E.verify_equations(I.problems(spark, sf)), ["l_returnflag"], rollup=True)
    return rates.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("right_rate", "wrong_rate", "error_rate")])


@query
def mean_loss(spark, sf):
    df = M.mean_loss(I.table(spark, sf, "events"), "value", ["event_type"])
    return df.select("event_type", F.round("mean_loss", 6).alias("mean_loss"), "samples")


@query
def class_metrics(spark, sf):
    df = M.class_metrics(I.table(spark, sf, "labels"), "quality", "toxic")
    return df.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def text_overlap_metrics(spark, sf):
    predicted = (
        F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", "p_type", "p_name", "p_name"))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("The "), F.upper("p_name"), F.lit("!")))
        .otherwise(F.col("p_brand"))
    )
    df = I.table(spark, sf, "part").select("p_brand", "p_name", predicted.alias("predicted"))
    scores = M.text_overlap_metrics(df, "predicted", "p_name", ["p_brand"])
    return scores.select("p_brand", F.round("exact", 9).alias("exact"), F.round("f1", 9).alias("f1"))


@query
def corr_metrics(spark, sf):
    df = M.corr_metrics(I.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return df.select("n", F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))


# Streaming


def _document_stream(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    return T.stream_table(spark, f"{sf}/documents*.parquet", "doc_id bigint, text string", tasks=cores)


@query
def stream_tokenize(spark, sf):
    path = scratch(spark, "stream")
    tokens = T.stream_tokenize(_document_stream(spark, sf).withColumn("text", I.hangul()), ["doc_id"])
    T.run_to_parquet(tokens, f"{path}/out", f"{path}/state")
    return text_of(spark.read.parquet(f"{path}/out"), "ids")


@query
def stream_corrupt(spark, sf):
    path = scratch(spark, "stream")
    pairs = T.stream_corrupt(_document_stream(spark, sf).withColumn("text", I.hangul()), ["doc_id"])
    T.run_to_parquet(pairs, f"{path}/out", f"{path}/state")
    return text_of(spark.read.parquet(f"{path}/out"), "inputs", "targets")


@query
def stream_verify(spark, sf):
    path = scratch(spark, "stream")
    I.problems(spark, sf).select("equation", "ans").write.json(f"{path}/in")
    arriving = T.stream_table(spark, f"{path}/in", "equation string, ans string", "json", files_per_batch=2)
    T.run_counts(T.verdict_counts(arriving), f"{path}/out", f"{path}/state")
    return T.latest_counts(spark, f"{path}/out")


EPOCHS = 3


@query
def endless_epochs(spark, sf):
    """The first epochs of an endless stream, stopped in its middle and started again."""
    path = scratch(spark, "epochs")
    O.write_shards(I.documents(spark, sf).select("doc_id", "lang"), f"{path}/in", ["doc_id"], rows_per_shard=64)
    shards = spark.read.parquet(f"{path}/in/sizes").count()
    for epochs in (1, EPOCHS):
        stream = O.stream_epochs(spark, f"{path}/in", "doc_id bigint, lang string", shardsPerTrigger=shards // 2 + 1)
        T.run_until(stream, f"{path}/out", f"{path}/state", F.max("epoch") >= epochs)
    return spark.read.parquet(f"{path}/out").where(F.col("epoch") < EPOCHS)


@query
def stream_shuffle(spark, sf):
    """Documents that arrive in three parts, through shuffle buffers; then the end."""
    path = scratch(spark, "shuffled")
    docs = I.documents(spark, sf).select("doc_id", "lang")
    first, second = docs.agg(F.expr("percentile_approx(doc_id, array(0.3, 0.6))").alias("m")).first()["m"] or (0, 0)
    part = F.when(F.col("doc_id") <= first, 0).when(F.col("doc_id") <= second, 1).otherwise(2)
    U.end_lanes(spark, f"{path}/ends", lanes=0)
    for k in range(4):
        if k < 3:
            docs.where(part == k).write.mode("append").parquet(f"{path}/in")
        else:
            U.end_lanes(spark, f"{path}/ends", lanes=8)
        arriving = T.stream_table(spark, f"{path}/in", "doc_id bigint, lang string")
        ends = T.stream_table(spark, f"{path}/ends", "lane bigint")
        U.run_with_state(U.shuffle_stream(arriving, ends, ["doc_id"], "doc_id", size=16, lanes=8), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


# Recipes, mixtures and whole jobs


@query
def recipe_registry(spark, sf):
    """Size of what every registered recipe makes of the corpus."""
    docs = I.numbered_korean(spark, sf)
    out = None
    for name, pairs in run_together(list(registry.recipes.values()), docs, pack=True).items():
        inputs, targets = (Z.size_of(side, Z.is_packed(pairs, side)) for side in ("inputs", "targets"))
        sizes = pairs.agg(F.count("*").alias("examples"), F.sum(inputs).alias("input_ids"), F.sum(targets).alias("target_ids"))
        sizes = sizes.select(F.lit(name).alias("recipe"), "*")
        out = sizes if out is None else out.unionByName(sizes)
    return out


@query
def step_callables(spark, sf):
    """Corruption with every step swapped: denser noise, and the two sides exchanged."""
    denser = S.NoiseSpans(seed=5, density=0.5, mean_span=3.0)
    pairs = corrupt(
        _byte_segments(spark, sf, pack=True),
        ["doc_id", "segment"],
        S.BYTES_ASCENDING,
        inputs_step=S.corrupt_targets,
        targets_step=S.corrupt_inputs,
        spans_step=denser,
    )
    return text_of(pairs, "inputs", "targets")


@query
def sql_recipe(spark, sf):
    """A recipe run from SQL text."""
    register_tables(spark)
    records = I.numbered_korean(spark, sf).selectExpr("record_no div 128 AS group_id", "record_no", "text")
    pairs = spark.sql(
        "SELECT * FROM masked_pairs(TABLE(SELECT * FROM {records}) PARTITION BY group_id ORDER BY (record_no), 'letters_ascending')",
        records=records,
    )
    return text_of(pairs, "inputs", "targets")


@query
def mixture_registry(spark, sf):
    """Rows and epochs that each source adds to the registered mixture, with French in the place of Korean."""
    docs = I.documents(spark, sf).select("doc_id", F.when(F.col("lang") == "fr", "ko").otherwise(F.col("lang")).alias("lang"))
    total = docs.agg((F.count("*") * 3).alias("n")).scalar()
    mixed = X.mix_fixed_rates(docs, "lang", ["doc_id"], registry.mixture("korean_english"), total)
    return mixed.groupBy("lang", "epoch").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


tasks = Registry()
for _recipe in registry.recipes.values():
    tasks.add(_recipe)
tasks.add_mixture("by_function", ["letters_ascending", "bytes_ascending"], lambda task, count: 7 if task.startswith("letters") else 3)


@query
def mixture_tasks(spark, sf):
    """Examples of two recipes, French as letters and English as bytes, at rates that a function gives."""
    docs = I.documents(spark, sf)
    numbered = lambda lang, text: with_shuffled_position(
        docs.where(F.col("lang") == lang).select("doc_id", text.alias("text")), ["doc_id"], name="record_no"
    )
    sources = {"letters_ascending": numbered("fr", I.hangul()), "bytes_ascending": numbered("en", F.col("text"))}
    mixed = jobs.mixture_examples("by_function", sources, registered=tasks)
    return mixed.select("task", "group_id", "segment", "epoch", "pos")


@query
def pretraining_corpus(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", "lang", I.hangul().alias("text"))
    packed = jobs.pretraining_corpus(docs, "letters_ascending", ["doc_id"], rates={"fr": 0.7, "en": 0.3}, packed_ids=True)
    return Q.spelled(packed, PACKED)


@query
def eval_holdout(spark, sf):
    docs = I.numbered(spark, sf).select("record_no", I.hangul().alias("text"))
    return text_of(jobs.eval_holdout(docs), "inputs", "targets")


@query
def equation_corpus(spark, sf):
    return jobs.equation_corpus(I.problems(spark, sf), keep=["l_orderkey", "l_linenumber"])


@query
def labelled_text(spark, sf):
    rows = R.zip_text_labels(I.documents(spark, sf).select("doc_id", I.hangul().alias("text")), I.table(spark, sf, "labels"), "doc_id", "quality")
    out = jobs.labelled_text(rows)
    return text_of(out, "source_ids", "source_mask", "target_ids", "target_mask", "labels")


@query
def corpus_token_counts(spark, sf):
    """Flagship: whole documents tokenised, ended, and counted by language."""
    added = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    both = bind(Q.append_eos(letter_ids("text")), lambda v: F.struct(F.size(v).alias("n"), added(v).alias("s")))
    counted = I.korean(spark, sf).select("lang", both.alias("c")).select("lang", "c.n", "c.s")
    return counted.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("s").alias("id_sum"))
