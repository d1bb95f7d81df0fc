"""Applying a set of rules to a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.ladders import date_ladder, number_ladder
from veilwright.functions.masks import mask_constant, mask_prefix, mask_tail
from veilwright.functions.text import timestamp_text
from veilwright.functions.values import as_moment, is_number, number_as_read, number_known, number_or_nan
from veilwright.operators.bins import dates_adaptive, dates_equal, equal_widths, general, year
from veilwright.operators.categories import category, typed, value_text
from veilwright.operators.matching import all_of
from veilwright.spec import DEFAULT_MASK, GENERAL, GENERAL_FIRST, UNKNOWN, Rule, check_columns


def ordering(df: DataFrame, name: str, rule: Rule) -> Column:
    """Numeric layers; a number outside of all of them keeps its own text."""
    return number_ladder(number_or_nan(df, name), rule.number_layers, number_as_read(df, name))


def dates(df: DataFrame, name: str, rule: Rule) -> Column:
    """Date layers; a moment outside of all of them keeps its own text."""
    moment = as_moment(df, name)
    return date_ladder(moment, rule.date_layers, timestamp_text(moment))


def masking(df: DataFrame, name: str, rule: Rule) -> Column:
    return mask_prefix(value_text(df, name), DEFAULT_MASK if rule.mask is None else rule.mask)


LAYERED = {"ordering": ordering, "dates": dates, "masking": masking, "category": lambda df, name, rule: category(df, name)}


def generalize(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Rewrite every column a layered rule names, all in one projection.

    Stateless: works on a stream as well.  An unknown method leaves its column alone.
    """
    check_columns(df.columns, list(rules), "rule")
    flat = [name for name, rule in rules.items() if rule.flat]
    if flat:
        raise ValueError(f"flat rules of {', '.join(flat)} take their bins from the data: use generalize_auto")
    rewritten = {
        name: LAYERED[rule.method](df, name, rule) for name, rule in rules.items() if rule.method in LAYERED
    }
    return df.select(*[rewritten[c].alias(c) if c in rewritten else F.col(f"`{c}`") for c in df.columns])


def generalize_typed(df: DataFrame, rules: Mapping[str, Rule], order_col: str) -> DataFrame:
    """Layered rules whose categories become numbered types instead of keeping their text."""
    plain = {name: rule for name, rule in rules.items() if rule.method != "category"}
    check_columns(df.columns, list(rules), "rule")
    out = df
    for name in rules:
        if name not in plain:
            out = typed(out, name, order_col)
    return generalize(out, plain)


def generalize_known(df: DataFrame, qis: Sequence[str], rules: Mapping[str, Rule]) -> DataFrame:
    """Generalise and keep the rows whose quasi-identifiers are all known afterwards.

    Whether a label will be NULL shows in the raw column already, so the filter is put on
    that: it is cheap and reaches the scan.  The labels then count as never NULL, which spares
    the optimizer from guarding every later join with a null test on the whole label.
    """
    check_columns(df.columns, [*rules, *qis], "rule or quasi-identifier")
    tests = []
    for q in qis:
        method = rules[q].method if q in rules else ""
        if method == "ordering":
            tests.append(number_known(df, q))
        elif method == "dates":
            tests.append(as_moment(df, q).isNotNull())
        elif method != "masking":
            tests.append(F.col(f"`{q}`").isNotNull())
    rows = generalize(df.filter(all_of(tests)) if tests else df, rules)
    labels = {q for q in qis if q in rules and rules[q].method in LAYERED}
    return rows.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in labels else F.col(f"`{c}`") for c in rows.columns]
    )


@dataclass(frozen=True)
class Style:
    """How one generation of flat rules treats a column."""

    null_bin: str  # where unknown numbers go, see equal_width
    dates: Callable[[DataFrame, str], Column] | None = None
    mask: str = ""  # "constant" or "tail"
    types: bool = False  # whether categories become numbered types
    unknown_type: str | None = None  # what an unknown category becomes
    text_only: bool = False  # cut text only: other values, and the marker itself, get no exception
    rest: str = GENERAL  # the category of all that is no number and has no rule


STYLES = {
    "ranges": Style("last", rest=GENERAL_FIRST),
    "adaptive": Style("first", dates_adaptive, "constant"),
    "years": Style("first", year, "constant"),
    "yearly": Style("first", year, "tail", types=True, unknown_type=UNKNOWN, text_only=True),
    "equal": Style("null", dates_equal, "tail", types=True),
}


def generalize_auto(
    df: DataFrame, qis: Sequence[str], rules: Mapping[str, Rule] | None = None, style: str = "equal", order_col: str | None = None
) -> DataFrame:
    """Generalise quasi-identifiers by flat rules, filling in a default where there is none.

    Without a rule a number gets equal-width bins and anything else one general category.
    ``order_col`` gives the row order that ``category`` rules count types by.
    """
    rules = rules or {}
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; choose one of {', '.join(STYLES)}")
    check_columns(df.columns, list(qis), "quasi-identifier")
    chosen = STYLES[style]
    methods = {name: rules[name].method if name in rules else None for name in qis}
    binned = [name for name, m in methods.items() if m == "ordering" or (m is None and is_number(df, name))]
    rewritten: dict[str, Column] = equal_widths(df, binned, chosen.null_bin)
    numbered: list[str] = []
    for name, method in methods.items():
        if name in rewritten:
            continue
        number = is_number(df, name)
        if method is None:
            rewritten[name] = general(chosen.rest)
        elif method == "masking" and (chosen.mask == "constant" or (chosen.mask and chosen.text_only and number)):
            rewritten[name] = mask_constant()
        elif method == "masking" and chosen.mask:
            rewritten[name] = mask_tail(value_text(df, name), marker_stays=not chosen.text_only)
        elif method == "dates" and chosen.dates is not None:
            rewritten[name] = chosen.dates(df, name)
        elif method == "category" and chosen.types:
            numbered.append(name)
        else:
            raise ValueError(f"rule {method!r} of column {name!r} is unknown in style {style!r}")
    if numbered and order_col is None:
        raise ValueError(f"rule 'category' of {', '.join(numbered)} needs order_col to count types by")
    out = df
    for name in numbered:
        out = typed(out, name, order_col, null_as=chosen.unknown_type)
    return out.select(*[rewritten[c].alias(c) if c in rewritten else F.col(f"`{c}`") for c in df.columns])
