"""Consecutive numbers over a table of any size, without one task seeing it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.operators.lineage import stored

#: Rows that one task puts in order, about.
ORDERED = 1 << 16
CELL_BITS = 16
BLOCK_BITS = 40


def number_ties(df: DataFrame, position: str, name: str, tie: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in the order of ``position``, ties by ``tie``, of which any number may share a position.

    The table is written down and counted.  Up to ``ORDERED`` rows are numbered by one task.  More are cut into ranges of
    position and tie together, at boundaries sampled from the rows, so rows of one position spread over as many
    ranges as they need; ranges are counted, and rows ordered within their own.
    """
    taken = {c.lower() for c in df.columns}
    if taken & {"part", "before", "of"}:
        raise ValueError("columns part, before and of are made here")
    rows = stored(df)
    parts = -(-rows.count() // ORDERED)
    if parts < 2:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(position, tie)).cast("bigint"))
    ranged = stored(rows.repartitionByRange(parts, position, tie).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(F.col("part").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("of", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(position, tie))
    numbered = ranged.withColumn(name, inside).join(offsets, F.col("part") == F.col("of"))
    return numbered.withColumn(name, F.col(name) + F.col("before")).drop("part", "of", "before")


def number_rows(df: DataFrame, position: Column, name: str, tie: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in the order of a whole-number ``position``, ties by ``tie``.

    Positions are grouped into cells of 2^16 and blocks of 2^40.  Counts per cell and block
    give every cell its offset, and rows are ordered inside their own cell only.  So with
    distinct positions no task orders more than 65,536 rows, 2^24 cells or 2^24 blocks,
    however many rows there are.  For positions that many rows share see ``number_ties``.
    """
    placed = df.withColumn("__at", position.cast("bigint"))
    placed = placed.withColumns(
        {"__cell": F.shiftright("__at", CELL_BITS), "__block": F.shiftright("__at", BLOCK_BITS)}
    )
    cells = placed.groupBy("__block", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        cells.groupBy("__block")
        .agg(F.sum("__n").alias("__rows"))
        .select("__block", (F.sum("__rows").over(upto) - F.col("__rows")).alias("__before_block"))
    )
    within = Window.partitionBy("__block").orderBy("__cell")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        cells.withColumn("__before_cell", F.sum("__n").over(within) - F.col("__n"))
        .join(blocks, "__block")
        .select("__cell", (F.col("__before_block") + F.col("__before_cell")).alias("__offset"))
    )
    inside = Window.partitionBy("__cell").orderBy("__at", tie)
    return (
        placed.withColumn("__rank", F.row_number().over(inside))
        .join(offsets, "__cell")
        .withColumn(name, F.col("__offset") + F.col("__rank"))
        .drop("__at", "__cell", "__block", "__rank", "__offset")
    )
