"""Models that perturb values: Laplace and Gaussian noise, randomised response, blanked cells.

Noise is added per row with sensitivity 1.  That blurs the input but gives no formal
differential-privacy guarantee for the released table, and the layered model leaves numbers
without noise altogether.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.chance import Chance, gaussian_sd, keyed_hash
from veilwright.functions.ladders import date_ladder, number_ladder
from veilwright.functions.masks import mask_constant, mask_prefix, mask_tail
from veilwright.functions.text import number_text
from veilwright.functions.values import as_moment, as_number, epoch_day, is_number, number_as_read
from veilwright.operators.bins import decade_label, quarter
from veilwright.operators.categories import typed, value_text
from veilwright.operators.numbering import number_rows
from veilwright.operators.suppression import drop_null_rows, null_cells, star_sync
from veilwright.spec import (
    DEFAULT_BUDGET,
    DEFAULT_DELTA,
    DEFAULT_NOISY_MASK,
    NOT_A_DATE,
    STAR,
    UNKNOWN,
    Rule,
    check_columns,
)

Rules = Mapping[str, Rule]
NULL_TEXT = "nan"  # fixed value: text of a missing value where it is masked or cut like any other


def even_split(epsilon: float, budget: float, columns: int) -> float:
    """Epsilon per column when the budget is taken as a plain factor."""
    return epsilon * (budget / columns)


def percent_split(epsilon: float, budget: float, columns: int) -> float:
    """Epsilon per column when the budget is a percentage."""
    return epsilon * (budget / 100) / columns


def moved_date(df: DataFrame, name: str, noise: Column) -> Column:
    """The date moved by ``noise`` days and rounded down to a day."""
    return F.date_from_unix_date(F.floor(epoch_day(as_moment(df, name)) + noise).cast("int"))


def date_text(date: Column) -> Column:
    """A date as text; an unknown date gives its fixed text."""
    return F.coalesce(date.cast("string"), F.lit(NOT_A_DATE))


def budget_rebin(df: DataFrame, name: str, noise: Column, threshold: float) -> Column:
    """Decade of the noisy number; a draw smaller than ``threshold`` shows as a star.

    The decades span the true values, so a noisy number outside of them becomes NULL.
    ``noise`` is a column of the table: a draw written out here would be repeated.
    """
    value = as_number(df, name).cast("double")
    limits = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    label = F.when(F.abs(noise) < threshold, STAR).otherwise(decade_label(value + noise, limits))
    return F.when(value.isNotNull(), label)


def randomized_response(df: DataFrame, name: str, probability: float, chance: Chance) -> DataFrame:
    """With the given probability replace a value by one of the *other* values, evenly chosen.

    The distinct values are numbered in hash order.  A replaced row draws a number among the
    others and looks it up, so no list of all values is held anywhere; both look-ups are plain
    equi-joins, broadcast by AQE when the numbered values are few.  NULL stays.
    """
    column = F.col(f"`{name}`")
    distinct = df.filter(column.isNotNull()).select(column.alias("__value")).distinct()
    # hash order spreads the numbering evenly; the value itself breaks ties
    position = F.conv(F.substring(keyed_hash(chance.seed, ["__value"]), 1, 12), 16, 10).cast("bigint")
    numbered = number_rows(distinct, position, "__number", tie="__value").select("__value", "__number")
    total = distinct.agg(F.count(F.lit(1))).scalar()
    own = numbered.select(F.col("__value").alias("__own"), F.col("__number").alias("__own_number"))
    # the draws must be fixed before the joins: a draw must not depend on where a row lands
    drawn = df.withColumns(
        {"__hit": chance.uniform(f"{name}/hit"), "__pick": chance.uniform(f"{name}/pick"), "__others": total - 1}
    )
    placed = drawn.join(own, column == F.col("__own"), "left")
    others = F.col("__others")
    step = F.least(F.floor(F.col("__pick") * others), others - 1) + 1
    other = F.when(
        (F.col("__hit") < F.lit(probability)) & (others > 0),
        F.when(step < F.col("__own_number"), step).otherwise(step + 1),
    )
    # most rows draw nothing: they get scattered negative numbers, not one common NULL key
    nowhere = -1 - F.floor(F.col("__pick") * F.lit(float(2**31))).cast("bigint")
    found = placed.withColumn("__other", F.coalesce(other, nowhere)).join(
        numbered.select(F.col("__value").alias("__new"), F.col("__number").alias("__new_number")),
        F.col("__other") == F.col("__new_number"),
        "left",
    )
    value = F.when(F.col("__new_number").isNotNull() & column.isNotNull(), F.col("__new")).otherwise(column)
    return found.select(*[value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def response_probability(epsilon: float) -> float:
    return 1 / (1 + math.exp(epsilon))


def typed_response(df: DataFrame, name: str, probability: float, chance: Chance, order_col: str) -> DataFrame:
    """Randomised response, then numbered types in the order in which the answers appear."""
    return typed(randomized_response(df, name, probability, chance), name, order_col, number_null=True)


@dataclass(frozen=True)
class Variant:
    """What one generation of the noise model does to each kind of column."""

    split: str  # how the budget is divided: "even", "percent" or "none"
    dates: str  # "layers" (noise, then layers), "noise" or "quarter"
    numbers: str  # "layers", "noise", "noise_layers" or "rebin"
    masks: str  # "prefix", "tail" or "constant"
    categories: str = ""  # "text", "types", "response" or "typed_response"
    gaussian: bool = False
    sensitive_types: bool = False  # number the types of sensitive columns too
    blank: bool = False  # blank cells at the threshold
    full_rows: bool = False  # keep only rows without NULL
    stars: bool = False  # star rows as a whole


VARIANTS = {
    "layered": Variant("even", "layers", "layers", "prefix", "text", blank=True),
    "laplace": Variant("none", "noise", "noise", "constant"),
    "gaussian": Variant("none", "noise", "noise", "constant", gaussian=True),
    "budgeted_gaussian": Variant("percent", "quarter", "rebin", "constant", gaussian=True, stars=True),
    "laplace_response": Variant("even", "noise", "noise", "tail", "response", blank=True, full_rows=True),
    "layered_typed": Variant(
        "even", "layers", "layers", "prefix", "types", sensitive_types=True, blank=True, full_rows=True
    ),
    "layered_response": Variant(
        "even", "layers", "noise_layers", "prefix", "typed_response", blank=True, full_rows=True
    ),
}


def _masked(df: DataFrame, name: str, rule: Rule, kind: str, compat: bool) -> Column:
    text = value_text(df, name)
    if kind == "constant":
        return mask_constant()
    if kind == "tail":
        return mask_tail(F.coalesce(text, F.lit(NULL_TEXT)), short=None, marker_stays=False)
    pattern = DEFAULT_NOISY_MASK if rule.mask is None else rule.mask
    return mask_prefix(F.coalesce(text, F.lit(NULL_TEXT)) if compat else text, pattern)


def _number(df: DataFrame, name: str, rule: Rule, kind: str, noise: Column, threshold: float) -> Column:
    value = as_number(df, name)
    if kind == "layers":
        return number_ladder(value, rule.number_layers, number_as_read(df, name))
    if kind == "noise":
        return value + noise
    if kind == "noise_layers":
        noisy = value + noise
        return number_ladder(noisy, rule.number_layers, number_text(noisy))
    return budget_rebin(df, name, noise, threshold)


def differential_privacy(
    df: DataFrame,
    qis: Sequence[str],
    epsilon: float,
    rules: Rules,
    budget: float = DEFAULT_BUDGET,
    threshold: float = 0.0,
    delta: float = DEFAULT_DELTA,
    sensitive: Sequence[str] = (),
    variant: str = "layered",
    chance: Chance | None = None,
    order_col: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Perturb the quasi-identifiers by their rules; see ``VARIANTS`` for what each variant does.

    All draws are made in one projection below the one that uses them, so a draw that decides
    several things (a label and a star) is made once.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; choose one of {', '.join(VARIANTS)}")
    if not epsilon:
        raise ValueError("epsilon must not be 0")
    check_columns(df.columns, list(qis), "quasi-identifier")
    chosen, chance = VARIANTS[variant], chance or Chance()
    splits = {"even": even_split, "percent": percent_split, "none": lambda e, _budget, _columns: e}
    share = splits[chosen.split](epsilon, budget, len(qis))
    sd = gaussian_sd(share, delta if chosen.split == "percent" else DEFAULT_DELTA)
    drawn: dict[str, Column] = {}
    rewritten: dict[str, Column] = {}
    types: dict[str, str] = {}
    answers: list[str] = []

    def draw(name: str) -> Column:
        column = f"__drawn_{len(drawn)}"
        drawn[column] = chance.gaussian(name, sd) if chosen.gaussian else chance.laplace(name, 1 / share)
        return F.col(column)

    for name in qis:
        rule = rules.get(name)
        method = rule.spelled if rule else ""
        if method == "dates" and chosen.dates == "quarter":
            rewritten[name] = quarter(df, name)
        elif method == "dates":
            moved = moved_date(df, name, draw(name))
            plain = date_text(moved)
            layered = chosen.dates == "layers"
            rewritten[name] = date_ladder(moved.cast("timestamp_ntz"), rule.date_layers, plain) if layered else plain
        elif method == "ordering" and is_number(df, name):
            noise = F.lit(0) if chosen.numbers == "layers" else draw(name)
            rewritten[name] = _number(df, name, rule, chosen.numbers, noise, threshold)
        elif method == "masking":
            rewritten[name] = _masked(df, name, rule, chosen.masks, compat)
        elif method == "category" and chosen.categories == "text":
            rewritten[name] = F.coalesce(value_text(df, name), F.lit(UNKNOWN))
        elif method == "category" and chosen.categories == "types":
            types[name] = "type"
        elif method == "category" and chosen.categories:
            answers.append(name)
    for name in sensitive if chosen.sensitive_types else ():
        if name in rules and rules[name].spelled == "category":
            check_columns(df.columns, [name], "sensitive")
            types[name] = "sensitive_type"
    if (types or (answers and chosen.categories == "typed_response")) and order_col is None:
        raise ValueError("rule 'category' needs order_col to count types by")

    out = df.withColumns(drawn) if drawn else df
    for name, prefix in types.items():
        out = typed(out, name, order_col, prefix=prefix, number_null=True)
    for name in answers:
        probability = response_probability(epsilon)
        if chosen.categories == "typed_response":
            out = typed_response(out, name, probability, chance, order_col)
        else:
            out = randomized_response(out, name, probability, chance)
    out = out.select(*[rewritten[c].alias(c) if c in rewritten else F.col(f"`{c}`") for c in df.columns])
    if chosen.stars:
        out = star_sync(out, qis)
    if chosen.blank:
        out = null_cells(out, threshold, chance)
    return drop_null_rows(out) if chosen.full_rows else out
