"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws an exponential number with its weight as rate from a hash of (record key, shard),
and the record goes to the shard with the smallest draw.  A shard gets records in proportion to its
weight, and the draws of the other shards do not change when one is added: it takes only the records
for which it draws the smallest number, and no record moves between old shards.

Rows: a NULL key is a key like any other.  Any other column is left alone; a column that already has
the name of a result is replaced.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.llm.common import before, spread_copies

#: Bits of a hash that a double holds exactly.
HASH_BITS = 53
#: Cells per shard in which rows are numbered; 10^12 rows on 8 shards make 8 million to a cell.
CELLS = 16_384


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a record; ``weights`` has one positive number for each shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive numbers, one for each shard")

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(f"shard {shard}")), 64 - HASH_BITS)
        return -F.log((bits + F.lit(0.5)) / F.lit(float(2**HASH_BITS))) / F.lit(float(weight))

    draws = [F.struct(draw(i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*draws))["shard"]


def shard(df: DataFrame, key: Sequence[str], weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, where a record goes once a shard of weight ``added`` joins.

    Reads the key only and shuffles nothing.  A whole number is the same key whatever its type.
    """
    whole = T.ByteType | T.ShortType | T.IntegerType
    columns = [F.col(f"`{k}`").cast("bigint") if isinstance(df.schema[k].dataType, whole) else F.col(f"`{k}`") for k in key]
    return df.withColumns(
        {"shard": rendezvous(columns, weights), "grown_shard": rendezvous(columns, [*weights, added])}
    )


def number_within(df: DataFrame, group: str, name: str) -> DataFrame:
    """Number the rows of each ``group`` 0, 1, ... in a hash order, in the column ``name``.

    Rows are numbered in cells by hash, after the rows of the cells before were counted, so no task
    sees a whole group.  Equal rows are counted before they are shuffled and written out again
    afterwards: each copy gets a number of its own.  Carry only short columns through this.
    """
    own = [f"own_{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(df.columns, own, strict=True)])
    at = own[df.columns.index(group)]
    cell = F.pmod(F.xxhash64(F.lit("cell"), *own), F.lit(CELLS))
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("copies")).withColumn("cell", cell)
    cells = counted.groupBy(F.col(at).alias("group"), F.col("cell").alias("of")).agg(F.sum("copies").alias("rows"))
    offsets = cells.withColumn("offset", before(F.col("rows"), Window.partitionBy("group").orderBy("of")))
    ranked = counted.withColumn("before", before(F.col("copies"), Window.partitionBy(at, "cell").orderBy(*own)))
    same = F.col(at).eqNullSafe(F.col("group")) & (F.col("cell") == F.col("of"))
    placed = spread_copies(ranked.join(offsets, same), F.col("copies"), "copy")
    number = (F.col("offset") + F.col("before") + F.col("copy") - 1).alias(name)
    return placed.select(*[F.col(o).alias(c) for c, o in zip(df.columns, own, strict=True) if c != name], number)
