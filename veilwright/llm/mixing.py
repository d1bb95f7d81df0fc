"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 48-bit hash.  A source's target is met by taking all its rows some whole number of
times and the rows below a hash threshold once more.  The threshold comes from nested histograms:
sizes summed by source and the first 16 bits of the hash show the bucket in which the budget ends,
only rows of that boundary bucket are summed by the next 16 bits, and then by the last.  Rows are
never sorted, and a source that holds a third of the table is summed before it is shuffled.

Rows: NULL and empty texts have size 0 and are taken 0 words.  A NULL source is a source like any
other and comes last.  Equal rows share a hash; at the threshold only as many copies are taken as
fit.  The one row beyond the threshold that best fills what is left is taken too.  An empty table stays empty.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import before, fresh, small, spread_copies, stored

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the row hash, and bits by which each histogram refines the one before.
HASH_BITS, STEP_BITS = 48, 16


def words(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(key: Column, text: Column) -> Column:
    """48 bits of the MD5 of key and text; NULL counts as no text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), text)), 1, HASH_BITS // 4), 16, 10).cast(
        "bigint"
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to a table of one row per source (``source``, ``source_size``).

    Sources in order, NULL last, weigh ``weights``, repeating, and share ``share`` of all sizes.  No
    target exceeds ``most`` times its source: with sources ordered by limit per weight, those whose
    limit lies below an equal rate for the rest are at their limit, and the rest share what is left.
    The window has one row per source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    rate_left = (budget - before(F.col("limit"), order)) / (
        F.sum("weight").over(whole) - before(F.col("weight"), order)
    )
    full = listed.withColumns({"budget": budget, "full": F.col("limit") / F.col("weight") < rate_left})
    spent = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)
    shared = F.least(F.col("weight") * (F.col("budget") - spent) / open_weight, F.col("limit"))
    return full.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(shared)).select(
        "source", "source_size", "target"
    )


def _boundary(rows: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """``plan`` with ``bucket``, the hash bits above ``shift`` at which the budget ``left`` ends, and what is left there.

    ``rows`` have a source's bucket and size; a source with nothing left drops out.
    """
    sums = rows.groupBy("source", F.shiftright("hash", shift).alias("next")).agg(
        F.sum(F.col("size") * F.col("copies")).alias("sum")
    )
    order = Window.partitionBy("source").orderBy("next")
    running = sums.withColumn("spent", before(F.col("sum"), order)).withColumnRenamed("source", "of")
    inside = (F.col("spent") < F.col("left")) & (F.col("left") <= F.col("spent") + F.col("sum"))
    return running.join(plan, F.col("of").eqNullSafe(F.col("source")) & inside).select(
        "source", F.col("next").alias("bucket"), (F.col("left") - F.col("spent")).alias("left")
    )


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
) -> DataFrame:
    """Per row: key, ``source``, ``size`` in words, ``source_size``, ``target``, ``times`` it is taken, ``taken`` words.

    ``row_hash`` tells rows of one key apart.
    """
    key_column, text_column = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = stored(
        df.select(
            key_column.alias("key"),
            F.col(f"`{source}`").alias("source"),
            words(text_column).alias("size"),
            row_hash(key_column, text_column).alias("hash"),
        )
        .groupBy("key", "source", "size", "hash")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(
        targets(sizes, weights, share, most)
        .withColumn("whole", whole)
        .withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    )
    sources = plan.count()
    at = small(plan.filter("left > 0").select("source", "left"), sources)
    level = rows
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        edge = stored(_boundary(level, at, shift))
        at = small(edge, sources)
        here = F.col("of").eqNullSafe(F.col("source")) & (F.shiftright("hash", shift) == F.col("bucket"))
        renamed = small(edge.select(F.col("source").alias("of"), "bucket"), sources)
        level = rows.join(renamed, here, "left_semi")
        at = small(edge.select("source", "left"), sources)
    # at the boundary hash as many copies go in as fit, then the one row that best fills what is left
    of = F.col("of").eqNullSafe(F.col("source"))
    ends = edge.select(F.col("source").alias("of"), F.col("bucket").alias("cut"), "left")
    fits = F.least(F.floor(F.col("left") / F.sum("size")), F.min("copies"))
    ends = stored(
        rows.join(small(ends, sources), of & (F.col("hash") == F.col("cut")))
        .groupBy("of", "cut", "left")
        .agg(fits.alias("fits"), (F.col("left") - fits * F.sum("size")).alias("rest"))
    )
    unused = (F.col("hash") > F.col("cut")) | ((F.col("hash") == F.col("cut")) & (F.col("fits") < F.col("copies")))
    off = F.abs(F.col("size") - F.col("rest"))
    fills = (
        rows.join(small(ends, sources), of & unused & (off < F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "hash"))["hash"].alias("filler"))
        .select(F.col("source").alias("of"), "filler")
    )
    cuts = ends.select(F.col("of").alias("cut_of"), "cut", "fits")
    limits = plan.join(small(cuts, sources), F.col("source").eqNullSafe(F.col("cut_of")), "left").join(
        small(stored(fills), sources), of, "left"
    )
    limits = limits.select(
        F.col("source").alias("limit_of"), "source_size", "target", "whole", "cut", "fits", "filler"
    )
    below = (
        F.when(F.col("hash") < F.col("cut"), F.col("copies"))
        .when(F.col("hash") == F.col("cut"), F.col("fits"))
        .otherwise(0)
    )
    more = F.least(below + F.coalesce((F.col("hash") == F.col("filler")).cast("int"), F.lit(0)), F.col("copies"))
    joined = rows.join(small(limits, sources), F.col("source").eqNullSafe(F.col("limit_of"))).withColumn("more", more)
    each = spread_copies(joined, F.col("copies"), "copy")
    times = (F.col("whole") + (F.col("copy") <= F.col("more")).cast("int")).cast("bigint")
    return each.withColumn("times", times).select(
        F.col("key").alias(key),
        *([F.col("source")] if key != "source" else []),
        "size",
        "source_size",
        "target",
        "times",
        (F.col("size") * F.col("times")).alias("taken"),
        F.col("hash").alias("row_hash"),
    )


def apply_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``df`` with every row as often as the mix takes it."""
    own, hashed, times, copy = (fresh(name, df.columns) for name in ("own", "hashed", "times", "copy"))
    sums = (
        mix(df, key, text, source, **options)
        .groupBy(F.col(key).alias("of_key"), F.col("row_hash").alias("of_hash"))
        .agg(F.sum("times").alias(times))
        .filter(F.col(times) > 0)
    )
    rows = df.withColumns({own: F.col(f"`{key}`"), hashed: row_hash(F.col(f"`{key}`"), F.col(f"`{text}`"))})
    same = F.col(own).eqNullSafe(F.col("of_key")) & (F.col(hashed) == F.col("of_hash"))
    # equal rows are one here: their times are summed
    taken = rows.dropDuplicates([own, hashed]).join(sums, same).drop("of_key", "of_hash")
    return spread_copies(taken, F.col(times), copy).drop(own, hashed, times, copy)
