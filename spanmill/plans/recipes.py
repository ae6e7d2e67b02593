"""Named recipes and mixtures: a source, a list of DataFrame steps, declared features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from spanmill.functions.encode import byte_ids, letter_ids_expr
from spanmill.functions.spans import (
    BYTES_ASCENDING,
    BYTES_DESCENDING,
    INPUT_LENGTH,
    LETTERS_ASCENDING,
    TARGET_LENGTH,
    SentinelScheme,
    check_target_length,
)
from spanmill.operators.corpus import joined_segments
from spanmill.operators.corruption import corrupt
from spanmill.operators.projection import rekey, select_features
from spanmill.session import written

Step = Callable[[DataFrame], DataFrame]
Rate = float | Callable[[str, int], float]


def temperature_rate(temperature: float, maximum: int | None = None) -> Rate:
    """A rate that grows with the number of examples, capped, to the power 1/temperature."""
    return lambda name, count: float(count if maximum is None else min(count, maximum)) ** (1 / temperature)



@dataclass(frozen=True)
class Recipe:
    """Steps that turn a numbered corpus into examples, and the features to keep."""

    name: str
    steps: tuple[Step, ...]
    features: tuple[str, ...] = ("inputs", "targets")
    keys: tuple[str, ...] = ("group_id", "segment")
    packing: Step | None = None  # the last step, if it can give packed ids

    def run(self, source: DataFrame, keep: list[str] = [], pack: bool = False) -> DataFrame:
        """Keys and features of the examples, and those columns of ``keep`` that the steps leave; with ``pack``, ids are packed if they can be."""
        return self.finish(self.prepare(source), keep, pack)

    def prepare(self, source: DataFrame) -> DataFrame:
        """All steps but the last: what recipes with the same steps can share."""
        for step in self.steps[:-1]:
            source = source.transform(step)
        return source

    def finish(self, prepared: DataFrame, keep: list[str] = [], pack: bool = False) -> DataFrame:
        last = self.packing if pack and self.packing else self.steps[-1]
        keys = [c for c in (SOURCE, *self.keys) if c != SOURCE or c in prepared.columns]
        return select_features(prepared.transform(last), [*self.features, *keep], keys)


def run_together(recipes: list[Recipe], source: DataFrame, keep: list[str] = [], pack: bool = False) -> dict[str, DataFrame]:
    """Examples of each recipe over one source; steps that several recipes begin with run once."""
    shared: dict[tuple[Step, ...], DataFrame] = {}
    for recipe in recipes:
        first = recipe.steps[:-1]
        if first not in shared:
            shared[first] = written(recipe.prepare(source), "prepared")
    return {r.name: r.finish(shared[r.steps[:-1]], keep, pack) for r in recipes}


@dataclass
class Registry:
    """Recipes and mixtures by name."""

    recipes: dict[str, Recipe] = field(default_factory=dict)
    mixtures: dict[str, dict[str, Rate]] = field(default_factory=dict)

    def add(self, recipe: Recipe) -> Recipe:
        if recipe.name in self.recipes:
            raise ValueError(f"recipe {recipe.name} is already registered")
        self.recipes[recipe.name] = recipe
        return recipe

    def add_mixture(self, name: str, rates: dict[str, Rate] | list[str], default_rate: Rate = 1.0) -> None:
        """Rates by recipe or source name, or names that all have the default rate.

        A rate is a number, or a function of the name and the number of its examples.
        """
        if name in self.mixtures:
            raise ValueError(f"mixture {name} is already registered")
        self.mixtures[name] = dict(rates) if isinstance(rates, dict) else dict.fromkeys(rates, default_rate)

    def recipe(self, name: str) -> Recipe:
        return self.recipes[name]

    def mixture(self, name: str) -> dict[str, Rate]:
        return self.mixtures[name]

    def shares(self, name: str, counts: dict[str, int]) -> dict[str, float]:
        """The mixture's rates as shares of their sum, for sources that hold so many examples; empty ones have none."""
        named = {n: r for n, r in self.mixtures[name].items() if counts.get(n)}
        found = {n: float(r(n, counts[n]) if callable(r) else r) for n, r in named.items()}
        whole = sum(found.values())
        return {n: r / whole for n, r in found.items() if r > 0}


SOURCE = "source"  # a column of this name keeps sources apart: each is numbered, joined and cut by itself


def _within(df: DataFrame) -> list[str]:
    return [SOURCE] if SOURCE in df.columns else []


def keyed(df: DataFrame) -> DataFrame:
    """Empty inputs, and the text as targets."""
    return rekey(df, {"inputs": None, "targets": "text"}, keep=["record_no", *_within(df)])


def segmented(
    encode: Callable[[Column], Column], lengths: tuple[int, int] = (INPUT_LENGTH, TARGET_LENGTH), seed: int = 1, pack: bool = False
) -> Step:
    """Chunk, join and split; fails at once if the targets cannot fit. Packed ids are what :func:`masked` takes at less cost."""
    segment = check_target_length(lengths[1], input_length=lengths[0])
    return lambda df: joined_segments(df, "targets", "record_no", encode, segment, seed=seed, within=_within(df), pack=pack)


def masked(
    scheme: SentinelScheme, lengths: tuple[int, int] = (INPUT_LENGTH, TARGET_LENGTH), seed: int = 1, pack: bool = False
) -> Step:
    """Mask and end."""
    return lambda df: corrupt(df, [*_within(df), "group_id", "segment"], scheme, seed=seed, lengths=lengths, pack=pack)


# Expressions, so that joining and cutting need one exchange.
byte_segments, letter_segments = segmented(byte_ids, pack=True), segmented(letter_ids_expr, pack=True)


def pretraining_recipe(name: str, segments: Step, scheme: SentinelScheme) -> Recipe:
    return Recipe(name, (keyed, segments, masked(scheme)), packing=masked(scheme, pack=True))


registry = Registry()
registry.add(pretraining_recipe("bytes_descending", byte_segments, BYTES_DESCENDING))
registry.add(pretraining_recipe("bytes_ascending", byte_segments, BYTES_ASCENDING))
registry.add(pretraining_recipe("letters_ascending", letter_segments, LETTERS_ASCENDING))
registry.add_mixture("korean_english", {"ko": 0.7, "en": 0.3})
