"""Multi-level hierarchies: each value with a label per level, the top level being a star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.text import whole_text
from veilwright.functions.values import as_number, is_number
from veilwright.operators.bins import ladder_of, place
from veilwright.operators.categories import value_text
from veilwright.spec import STAR
from veilwright.streaming import require_batch

# Fixed value: interval levels of a numeric hierarchy.
NUMERIC_LEVELS = 3


def numeric_levels(df: DataFrame, name: str, levels: int = NUMERIC_LEVELS, widening: bool = False) -> Column:
    """Array of labels: own value, ``levels`` interval levels, star.

    All interval levels cut the range into ``levels`` equal parts, so they agree; with
    ``widening`` each level instead has one part fewer than the level below, which gives a
    search something to choose from.  The label is ``lo-(hi - 1)`` in whole numbers.
    """
    require_batch(df, "a hierarchy over the column's range")
    value = as_number(df, name).cast("double")
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))

    def ladder(parts: int) -> Column:
        step = (F.col("high") - F.col("low")) / parts

        def label(i: Column) -> Column:
            start = F.col("low") + step * (i - 1)
            # a constant column has no width: its only interval is the value itself
            end = F.when(step > 0, start + step - 1).otherwise(start)
            return F.concat(whole_text(start), F.lit("-"), whole_text(end))

        order = F.sequence(F.lit(1), F.when(step > 0, parts).otherwise(1))
        bounds = F.transform(order, lambda i: F.col("low") + step * i)
        return ladder_of(F.slice(bounds, F.lit(1), F.size(order) - 1), F.transform(order, label))

    parts = [levels - i if widening else levels for i in range(levels)]
    ladders = span.select(F.struct(*[ladder(p).alias(f"level_{i}") for i, p in enumerate(parts)])).scalar()
    middle = [place(value, ladders[f"level_{i}"]) for i in range(levels)]
    return F.array(whole_text(value), *middle, F.lit(STAR))


def categorical_levels(df: DataFrame, name: str) -> Column:
    """Array of labels: own value, star."""
    return F.array(value_text(df, name), F.lit(STAR))


def levels_of(df: DataFrame, name: str, widening: bool = False) -> tuple[Column, int]:
    """The array of labels and its length."""
    if is_number(df, name):
        return numeric_levels(df, name, widening=widening), NUMERIC_LEVELS + 2
    return categorical_levels(df, name), 2


def hierarchy_table(df: DataFrame, name: str, widening: bool = False) -> DataFrame:
    """(``value``, ``level``, ``label``) for every distinct known value of the column."""
    labels, _ = levels_of(df, name, widening)
    known = df.filter(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`")).distinct()
    return known.select(F.col(f"`{name}`").alias("value"), F.posexplode(labels).alias("level", "label"))


def sorted_values(df: DataFrame, name: str) -> DataFrame:
    """The distinct known values in order: the lowest level of a hierarchy."""
    return df.filter(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`")).distinct().orderBy(F.col(f"`{name}`"))
