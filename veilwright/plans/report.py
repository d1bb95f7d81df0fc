"""One row per class: how the privacy models would judge it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.operators.classes import class_stats, value_counts
from veilwright.operators.distance import kl_divergence, share_distance
from veilwright.operators.lineage import stored
from veilwright.operators.matching import attach


def privacy_report(
    df: DataFrame,
    base: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int | None = None,
    l: int | None = None,  # noqa: E741
    m: float | None = None,
    t: float | None = None,
) -> DataFrame:
    """Size, variety, top share and distances of every class, with a flag per given limit.

    ``df`` is the generalised table and ``base`` the original one the distances refer to.  The rows
    of ``df`` are counted once: the table of classes and values is written down as the plan is built,
    and all measures come from it.
    """
    counts = value_counts(df, qis, [sensitive])
    plain = [f"column_{i}" for i in range(len(counts.columns))]  # a file takes no names that differ in case only
    counted = stored(counts.toDF(*plain)).toDF(*counts.columns)
    stats = class_stats(df, qis, [sensitive], counted)
    apart = {"share_distance": share_distance, "kl_divergence": kl_divergence}
    report = stats
    for name, measure in apart.items():
        measured = measure(df, base, qis, sensitive, counted).withColumnRenamed("distance", name)
        report = attach(report, measured, qis, [name], how="left")
    flags = {}
    if k is not None:
        flags["below_k"] = F.col("class_size") < k
    if l is not None:
        flags["below_l"] = F.col("distinct_values") < l
    if m is not None:
        flags["above_share"] = F.coalesce(F.col("top_share") > F.lit(1 / m), F.lit(False))
    if t is not None:
        judged = (F.col("nulls") == 0) & (F.col("class_size") >= 2)
        flags["beyond_t"] = judged & F.coalesce(F.col("share_distance") > t, F.lit(False))
    return report.withColumns(flags) if flags else report
