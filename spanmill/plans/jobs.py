"""The four user-level jobs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.cleaning import clean_review_text
from spanmill.functions.draws import draw_hash
from spanmill.functions.encode import first_ids, letter_ids, special_letter_ids
from spanmill.functions.sequences import append_eos, attention_mask, ignore_padding, pad_to, truncate_ended, with_lists
from spanmill.functions.spans import LETTERS_ASCENDING, SentinelScheme, span_lengths
from spanmill.operators.corruption import corrupt
from spanmill.operators.equations import verify_equations
from spanmill.operators.mixing import batch_assign, mix_fixed_rates, mix_in_rate_order
from spanmill.operators.numbering import text_offsets, with_shuffled_position
from spanmill.operators.packing import pack_or_pad
from spanmill.operators.projection import label_text, project_task_triple
from spanmill.operators.splitting import eval_records
from spanmill.plans.recipes import SOURCE, Recipe, Registry, registry
from spanmill.session import written

LABEL_NAMES = ["negative</s>", "positive</s>"]  # fixed value: target text of labels 0 and 1
BUCKET = 1000  # examples, on average, whose short ones are packed together
BATCH = 8


def pretraining_corpus(
    corpus: DataFrame,
    recipes: str | Recipe | dict[str, str | Recipe],
    keys: list[str],
    source: str = "lang",
    rates: dict[str, float] | None = None,
    total: int | None = None,
    seed: int = 1,
    pack: bool = True,
    batch: int = BATCH,
    drop_last: bool = False,
    packed_ids: bool = False,
) -> DataFrame:
    """Corpus to packed training rows in batches.

    Each source goes through its recipe (one for all, or one by name) by
    itself: its records are shuffled, joined and cut apart from the others.
    ``total`` examples, as many as there are if not given, are then drawn at
    the sources' rates, put in a seeded order, packed and batched. The order
    is that of a digest, whose leading digits make the packing buckets; the
    examples are built once and written. Ids are packed on the way, and with
    ``packed_ids`` in the result, if all recipes can give them so.
    """
    named = corpus if rates is None else corpus.where(F.col(source).isin(list(rates)))
    records = with_shuffled_position(named, keys, seed, within=[source], name="record_no")
    records = records.select(F.col(source).cast("string").alias(SOURCE), "record_no", "text")
    by_recipe: dict[Recipe, list[str] | None] = {}
    if isinstance(recipes, dict):
        for name, recipe in recipes.items():
            by_recipe.setdefault(_recipe(recipe), []).append(name)
    else:
        by_recipe[_recipe(recipes)] = None
    small = all(r.packing for r in by_recipe)
    parts = [r.run(records if names is None else records.where(F.col(SOURCE).isin(names)), pack=small) for r, names in by_recipe.items()]
    examples = written(reduce(DataFrame.unionByName, parts), "examples")

    place = ["group_id", "segment"]
    total = examples.count() if total is None else total
    if rates is None:
        mixed = examples.withColumn("epoch", F.lit(0).cast("bigint"))
    else:
        mixed = mix_fixed_rates(examples, SOURCE, place, rates, total, seed)
    digits = max(0, math.ceil(math.log(max(total, 1) / BUCKET, 16)))
    ordered = mixed.withColumn("_order", draw_hash(seed, "order", SOURCE, *place, "epoch"))
    packs = pack_or_pad(ordered, ["_order", SOURCE], F.substring("_order", 1, digits), pack, packed_ids=small)
    packs = written(packs.withColumn("_block", F.substring("_order", 1, max(digits, 1))), "packs")
    offsets = text_offsets(packs.groupBy("_block").agg(F.count("*").alias("n")), "_block")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("_order")) - 1
    numbered = packs.withColumn("_inside", inside).join(offsets, "_block")
    numbered = numbered.withColumn("pos", F.col("offset") + F.col("_inside"))
    batched = batch_assign(numbered, "pos", batch, drop_last).drop("_order", SOURCE, "_block", "_inside", "offset")
    return batched if packed_ids else with_lists(batched)


def mixture_examples(
    name: str, sources: dict[str, DataFrame], total: int | None = None, seed: int = 1, registered: Registry = registry
) -> DataFrame:
    """``total`` examples of the tasks of a registered mixture, in an order of which every prefix keeps its rates.

    ``sources`` has a numbered corpus (``record_no``, ``text``) for each task of the mixture, which is named like its recipe. Each
    corpus runs through its recipe, the examples are written once, and rates are taken from how many there are. Returns
    ``task``, ``group_id``, ``segment``, the features, ``epoch`` and ``pos``.
    """
    parts = [registered.recipe(task).run(sources[task]).withColumn("task", F.lit(task)) for task in registered.mixture(name)]
    examples = written(reduce(DataFrame.unionByName, parts), "examples")
    counts = {r["task"]: r["n"] for r in examples.groupBy("task").agg(F.count("*").alias("n")).collect()}  # a row for each task
    if not counts:
        return examples.withColumns({"epoch": F.lit(0).cast("bigint"), "pos": F.lit(0).cast("bigint")})
    total = sum(counts.values()) if total is None else total
    return mix_in_rate_order(examples, "task", ["group_id", "segment"], registered.shares(name, counts), total, seed)


def _recipe(recipe: str | Recipe) -> Recipe:
    return registry.recipe(recipe) if isinstance(recipe, str) else recipe


def eval_holdout(
    numbered: DataFrame,
    encode: Callable[[Column], Column] = letter_ids,
    scheme: SentinelScheme = LETTERS_ASCENDING,
    seed: int = 1,
) -> DataFrame:
    """The holdout of a numbered corpus (``record_no``, ``text``) as masked pairs, one segment per record."""
    length, _ = span_lengths()
    held = eval_records(numbered).where(F.octet_length("text") > 0)
    ids = held.select("record_no", first_ids("text", length, encode).alias("ids"))
    return corrupt(ids, ["record_no"], scheme, seed=seed)


def equation_corpus(problems: DataFrame, text: str = "original_text_kr", keep: list[str] = []) -> DataFrame:
    """Problems whose equation gives their answer, as task triples."""
    return project_task_triple(verify_equations(problems).where("verdict = 'right'"), text, "equation", keep=keep)


def labelled_text(
    reviews: DataFrame, text: str = "text", label: str = "label", length: int = 512, target_length: int = 10
) -> DataFrame:
    """Labelled texts as padded ids with attention masks and loss labels."""
    source = append_eos(first_ids(clean_review_text(F.col(text)), length - 1))
    target = truncate_ended(special_letter_ids(label_text(F.col(label), LABEL_NAMES)), target_length)
    rest = [c for c in reviews.columns if c not in (text, label)]
    bare = reviews.select(*rest, source.alias("_s"), target.alias("_t"))
    return bare.select(
        *rest,
        pad_to(F.col("_s"), length).alias("source_ids"),
        attention_mask(F.col("_s"), length).alias("source_mask"),
        pad_to(F.col("_t"), target_length).alias("target_ids"),
        attention_mask(F.col("_t"), target_length).alias("target_mask"),
        ignore_padding(pad_to(F.col("_t"), target_length)).alias("labels"),
    )

