"""Generalisers of categories: own text, numbered types and lookup tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.functions.text import number_text
from veilwright.functions.values import FRACTIONAL
from veilwright.operators.numbering import number_ties
from veilwright.spec import MASKED, UNKNOWN, check_columns
from veilwright.streaming import require_batch


def value_text(df: DataFrame, name: str) -> Column:
    """A value as its own text."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return number_text(column)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


def category(df: DataFrame, name: str) -> Column:
    """The value's text; NULL stays NULL and the mask marker turns unknown."""
    text = value_text(df, name)
    return F.when(text == MASKED, UNKNOWN).otherwise(text)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def typed(
    df: DataFrame, name: str, order_col: str, prefix: str = "type", null_as: str | None = None, number_null: bool = False
) -> DataFrame:
    """Replace each value by ``typeN``, N being the order in which values first appear.

    ``order_col`` must hold whole numbers that put rows in order; a distributed table has no
    row order of its own.  NULL takes part in the counting like any value; its rows become
    ``null_as``, or its own number with ``number_null``.  The mask marker turns unknown.
    """
    require_batch(df, "numbered types")
    check_columns(df.columns, [name, order_col], "numbered")
    if not isinstance(df.schema[order_col].dataType, T.IntegralType):
        raise ValueError(f"order column {order_col!r} must hold whole numbers")
    column = F.col(f"`{name}`")
    firsts = df.groupBy(column.alias("__value")).agg(F.min(F.col(f"`{order_col}`")).alias("__first"))
    numbered = number_ties(firsts, "__first", "__number", tie="__value")
    labels = numbered.select("__value", F.concat(F.lit(prefix), F.col("__number").cast("string")).alias("__label"))
    joined = df.join(labels, column.eqNullSafe(F.col("__value")), "left")
    text = F.when(column.cast("string") == MASKED, UNKNOWN).otherwise(F.col("__label"))
    if not number_null:
        text = F.when(column.isNull(), F.lit(null_as)).otherwise(text)
    return joined.select(*[text.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def mapping_table(spark: SparkSession, mapping: Mapping[object, str]) -> DataFrame:
    """A lookup table from a small declared dictionary."""
    rows = [(None if k is None else str(k), v) for k, v in mapping.items()]
    if len({value for value, _ in rows}) < len(rows):
        raise ValueError("the mapping gives one value, written in several ways, more than one label")
    return spark.createDataFrame(rows, "value string, label string")


def map_values(df: DataFrame, name: str, mapping: DataFrame | Mapping[object, str], keep_unmapped: bool) -> DataFrame:
    """Look values up in a (value, label) table; others stay or become NULL.

    The table may be of any size: no broadcast is forced, so AQE broadcasts it only if it
    measures below the session's limit.  A value listed twice must have one label: rows are never
    multiplied, and the plan stops with an error where labels differ.
    """
    table = mapping if isinstance(mapping, DataFrame) else mapping_table(df.sparkSession, mapping)
    table = table.select(F.col(table.columns[0]).cast("string").alias("__value"), F.col(table.columns[1]).alias("__label"))
    clash = F.raise_error(F.concat(F.lit("different labels for the value "), F.col("__value"))).cast("string")
    same = F.min("__label").eqNullSafe(F.max("__label")) & (F.count("__label") % F.count(F.lit(1)) == 0)
    table = table.groupBy("__value").agg(F.when(same, F.min("__label")).otherwise(clash).alias("__label"))
    text = value_text(df, name)
    joined = df.join(table, text == F.col("__value"), "left")
    found = F.coalesce(F.col("__label"), text) if keep_unmapped else F.col("__label")
    return joined.select(*[found.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])
