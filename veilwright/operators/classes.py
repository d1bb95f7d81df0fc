"""Equivalence classes and their statistics.

All statistics come from two chained aggregates, so a class that holds a third of the table
is summed map-side first and never gathered anywhere:

``value_counts``   one row per class and sensitive value
``count_profile``  one row per class and *count*, with the number of values having it

A class of ``n`` rows has at most ``sqrt(2n)`` different counts (they are distinct whole
numbers that add up to at most ``n``), which bounds every per-class window used downstream.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.chance import lossless, marked
from veilwright.operators.matching import all_of, attach, cols
from veilwright.spec import MASKED, check_free
from veilwright.streaming import require_batch


#: Logarithm of the size of a sketch of distinct values.
SKETCH = 12
STATISTICS = ("class_size", "nulls", "distinct_values", "distinct_with_null", "top_count", "top_share")


def with_known_qis(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """Rows that belong to a class: none of their quasi-identifiers is NULL."""
    return df.filter(all_of([F.col(f"`{q}`").isNotNull() for q in qis]))


def without_masked(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """Rows where no quasi-identifier is NULL or carries the mask marker anywhere in its text."""
    return df.filter(
        all_of([F.coalesce(~F.col(f"`{q}`").cast("string").contains(MASKED), F.lit(False)) for q in qis])
    )


def class_sizes(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    require_batch(df, "class size")
    check_free(qis, ["class_size"])
    return with_known_qis(df, qis).groupBy(*cols(qis)).agg(F.count(F.lit(1)).alias("class_size"))


def attach_class_size(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """Every row with the size of its class; rows without a class drop out."""
    return attach(df, class_sizes(df, qis), qis, ["class_size"])


def value_counts(df: DataFrame, qis: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """(class, sensitive values, ``__n``); rows with a NULL sensitive value count under NULL."""
    require_batch(df, "class statistics")
    return with_known_qis(df, qis).groupBy(*cols([*qis, *sensitive])).agg(F.count(F.lit(1)).alias("__n"))


def _known(sensitive: Sequence[str]) -> Column:
    return all_of([F.col(f"`{s}`").isNotNull() for s in sensitive])


def class_stats(
    df: DataFrame, qis: Sequence[str], sensitive: Sequence[str], counted: DataFrame | None = None
) -> DataFrame:
    """One row per class.

    ``counted`` is the table of ``value_counts``, if there is one already.

    ``class_size``, ``nulls`` (rows with an unknown sensitive value), ``distinct_values``
    (known values), ``distinct_with_null``, ``top_count`` and ``top_share`` (the most
    frequent known value among the known rows).
    """
    check_free(qis, STATISTICS)
    known = _known(sensitive)
    counted = value_counts(df, qis, sensitive) if counted is None else counted
    stats = counted.groupBy(*cols(qis)).agg(
        F.sum("__n").alias("class_size"),
        F.coalesce(F.sum(F.when(~known, F.col("__n"))), F.lit(0)).alias("nulls"),
        F.count(F.when(known, F.lit(1))).alias("distinct_values"),
        F.max(F.when(known, F.col("__n"))).alias("top_count"),
    )
    known_rows = F.col("class_size") - F.col("nulls")
    return stats.withColumns(
        {
            "distinct_with_null": F.col("distinct_values") + (F.col("nulls") > 0).cast("bigint"),
            "top_share": F.when(known_rows > 0, F.col("top_count") / known_rows),
        }
    )


def class_sketches(df: DataFrame, qis: Sequence[str], sensitive: Sequence[str], lg_k: int = SKETCH) -> DataFrame:
    """(class, ``class_size``, ``nulls``, ``sketch``): a HyperLogLog sketch of the known sensitive values of each class.

    A sketch has at most about 2^``lg_k`` bytes however many values there are, and sketches of parts of a table
    can be stored and merged later (``merge_sketches``), so new rows need no look at the old ones.
    """
    require_batch(df, "class statistics")
    check_free(qis, ["class_size", "nulls", "sketch"])
    texts = [marked(lossless(F.col(f"`{s}`"), df.schema[s].dataType)) for s in sensitive]
    known = _known(sensitive)
    return with_known_qis(df, qis).groupBy(*cols(qis)).agg(
        F.count(F.lit(1)).alias("class_size"),
        F.count_if(~known).alias("nulls"),
        F.hll_sketch_agg(F.when(known, F.concat(F.lit(""), *texts)), lg_k).alias("sketch"),
    )


def merge_sketches(qis: Sequence[str], *tables: DataFrame) -> DataFrame:
    """One row per class from the sketches of several tables, made with one ``lg_k``."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(*cols(qis)).agg(
        F.sum("class_size").alias("class_size"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch")
    )


def sketched_stats(sketches: DataFrame, qis: Sequence[str]) -> DataFrame:
    """``class_size``, ``nulls``, ``distinct_values`` and ``distinct_with_null`` of each class, the last two estimated.

    The relative standard error is about 0.83 / sqrt(2^lg_k), 1.3 % by default; small numbers of values are exact.
    """
    values = F.hll_sketch_estimate("sketch")
    return sketches.select(
        *cols(qis), "class_size", "nulls", values.alias("distinct_values"),
        (values + (F.col("nulls") > 0).cast("bigint")).alias("distinct_with_null"),
    )


def own_shares(
    df: DataFrame, qis: Sequence[str], sensitive: Sequence[str], counted: DataFrame | None = None
) -> DataFrame:
    """``class_shares`` under working names: ``__n`` and ``__share``."""
    counted = value_counts(df, qis, sensitive) if counted is None else counted
    counted = counted.filter(_known(sensitive))
    totals = counted.groupBy(*cols(qis)).agg(F.sum("__n").alias("__known"))
    both = attach(counted, totals, qis, ["__known"])
    return both.withColumn("__share", F.col("__n") / F.col("__known")).drop("__known")


def class_shares(df: DataFrame, qis: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """(class, sensitive values, ``n``, ``share`` among the rows of the class with known values)."""
    check_free([*qis, *sensitive], ["n", "share"])
    return own_shares(df, qis, sensitive).withColumnsRenamed({"__n": "n", "__share": "share"})


def global_shares(df: DataFrame, sensitive: str) -> DataFrame:
    """(sensitive value, ``n``, ``share``) over all rows with a known value."""
    require_batch(df, "the global distribution")
    check_free([sensitive], ["n", "share"])
    known = df.filter(F.col(f"`{sensitive}`").isNotNull())
    counted = known.groupBy(*cols([sensitive])).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("share", F.col("n") / total)


def count_profile(df: DataFrame, qis: Sequence[str], sensitive: str, counted: DataFrame | None = None) -> DataFrame:
    """(class, ``__n``, ``__values``, ``__unknown``): how many known values occur ``__n`` times.

    The rows with an unknown value are counted in ``__unknown``, on a row of their own with
    NULL for ``__n`` and no values.
    """
    known = F.col(f"`{sensitive}`").isNotNull()
    counted = value_counts(df, qis, [sensitive]) if counted is None else counted
    counted = counted.select(
        *cols(qis),
        F.when(known, F.col("__n")).alias("__n"),
        F.when(known, 1).otherwise(0).alias("__one"),
        F.when(known, 0).otherwise(F.col("__n")).alias("__unknown"),
    )
    return counted.groupBy(*cols(qis), "__n").agg(
        F.sum("__one").alias("__values"), F.sum("__unknown").alias("__unknown")
    )
