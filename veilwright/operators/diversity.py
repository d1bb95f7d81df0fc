"""Measures of how varied the sensitive values of each class are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.operators.classes import count_profile
from veilwright.operators.matching import cols


def diversity_measures(df: DataFrame, qis: Sequence[str], sensitive: str, l: int, c: float = 1.0) -> DataFrame:  # noqa: E741
    """One row per class: distinct, entropy and recursive diversity of its known values.

    ``entropy_l`` is exp(-sum p ln p), the number of equally frequent values of the same
    entropy.  Recursive (c, l)-diversity compares the largest count r1 with the counts from
    the l-th largest on: ``recursive_ok`` says r1 < c * (r_l + ... + r_m).
    The counts are held as (count, number of values), so the running total that finds the
    l - 1 largest stays short in every class.
    """
    largest_first = Window.partitionBy(*cols(qis)).orderBy(F.col("__n").desc())
    upto = largest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = largest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    profile = count_profile(df, qis, sensitive).filter("__n IS NOT NULL").select(
        *cols(qis),
        "__n",
        "__values",
        (F.sum("__values").over(upto) - F.col("__values")).alias("__ahead"),
        F.sum(F.col("__n") * F.col("__values")).over(whole).alias("__rows"),
    )
    share = F.col("__n") / F.col("__rows")
    tail_values = F.greatest(F.lit(0), F.least(F.col("__values"), F.col("__ahead") + F.col("__values") - (l - 1)))
    measured = profile.groupBy(*cols(qis)).agg(
        F.sum("__values").alias("distinct_values"),
        F.exp(-F.sum(F.col("__values") * share * F.log(share))).alias("entropy_l"),
        F.max("__n").alias("top_count"),
        F.sum(F.col("__n") * tail_values).alias("tail_count"),
    )
    return measured.withColumn("recursive_ok", F.col("top_count") < F.lit(float(c)) * F.col("tail_count"))
