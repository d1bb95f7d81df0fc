"""Connected components of a graph given as a table of links, by joins and grouped minima alone.

Each round every node takes the smallest label among its own and its neighbours', and then the
label of that label, until nothing changes.  A label is always a node of the same component, and the
second step halves the remaining distance, so rounds grow with the logarithm of the longest chain.
A node with very many links is no problem: minima are taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import stored


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """Table (``node``, ``label``) for every node of a link; the label is the component's smallest node."""
    one, other = F.col(f"`{first}`").alias("node"), F.col(f"`{second}`").alias("next")
    both = links.select(one, other).filter("node <> next")
    both = stored(both.unionByName(both.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct())
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("next"), F.col("label").alias("near")), "next")
        near = seen.groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("via"), F.col("label").alias("old")
        )
        ahead = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = stored(
            lower.join(ahead, "via").select("node", F.least("via", "far").alias("label"), "old")
        )
        labels = moved.select("node", "label")
        if moved.filter("label < old").isEmpty():
            return labels
