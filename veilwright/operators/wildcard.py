"""Local suppression: blank as few quasi-identifiers as needed, NULL matching anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.functions.chance import lossless, marked
from veilwright.operators.lineage import stored
from veilwright.operators.lists import listed, prefix_free_in
from veilwright.spec import check_columns
from veilwright.streaming import require_batch

INTEGER_SENTINEL = -2147483648  # fixed value: how a missing whole number is written by some tools


def _ones(mask: Column) -> Column:
    return F.length(F.translate(mask, "0", ""))


def _closure(width: int) -> Column:
    """Mask of the columns in which all rows of a group agree, from their ``values``."""
    same = [F.when(F.min(F.get("values", F.lit(i))) == F.max(F.get("values", F.lit(i))), "1").otherwise("0") for i in range(width)]
    return F.concat(F.lit(""), *same)


def _without_one(classes: DataFrame, pending: DataFrame, k: int) -> DataFrame:
    """(cid, mask): classes that share all columns but one with ``k`` rows, and the best such columns."""

    def spread(table: DataFrame) -> DataFrame:
        rows = table.select("cid", "n", "values", F.posexplode("values").alias("i", "gone"))
        rest = F.array_join(F.filter("values", lambda _, j: j != F.col("i")), "")
        return rows.select("cid", "n", "i", rest.alias("rest"), F.size("values").alias("width"))

    every = spread(classes)
    asked = listed(every, spread(pending).select("i", "rest").distinct(), ["i", "rest"])
    shared = asked.only(every, "one gone").groupBy("i", "rest").agg(F.sum("n").alias("n")).filter(F.col("n") >= k)
    found = listed(every, shared, ["i", "rest"]).only(spread(pending), "one back")
    # the least important column that may go
    last = found.groupBy("cid").agg(F.max("i").alias("i"), F.first("width").alias("width"))
    mask = F.concat(F.repeat(F.lit("1"), F.col("i")), F.lit("0"), F.repeat(F.lit("1"), F.col("width") - F.col("i") - 1))
    return stored(last.select("cid", mask.alias("mask")))


def _largest_shared(classes: DataFrame, pending: DataFrame, k: int, width: int) -> DataFrame:
    """(cid, mask): for each pending class the largest, and then greatest, set of columns shared by ``k`` rows.

    Sets grow column by column.  Rows that agree in a set of columns form a group, and all columns in which
    they agree are its closed set; a group grows by the values of one later column.  It goes on only if it has ``k`` rows, a pending
    class among them that may still find a larger set there, and its closed set has not been met by an earlier column.
    """
    flags = pending.select(F.col("cid").alias("of"))
    rows = classes.join(flags, F.col("cid") == F.col("of"), "left")
    rows = rows.select("cid", "n", "values", F.col("of").isNotNull().alias("asks"))
    whole = classes.agg(F.sum("n").alias("n"), _closure(width).alias("mask")).collect()[0]
    nothing = pending.select("cid", F.lit(0).alias("size"), F.lit("0" * width).alias("mask"))
    if (whole["n"] or 0) < k:
        return nothing.select("cid", "mask")
    shape = [F.lit(0).cast("bigint").alias("key"), F.lit(whole["mask"]).alias("mask"), F.lit(-1).alias("core")]
    groups = rows.select(*shape, F.lit(whole["mask"].count("1")).alias("least"), "cid", "n", "asks", "values")
    best = stored(nothing.select("cid", F.lit(whole["mask"].count("1")).alias("size"), F.lit(whole["mask"]).alias("mask")))
    for _ in range(width):
        grown = groups.select("*", F.posexplode("values").alias("i", "value"))
        at_most = _ones(F.col("mask")) + 1 + F.length(F.translate(F.expr("substring(mask, i + 2)"), "1", ""))
        new = (F.col("i") > F.col("core")) & (F.expr("substring(mask, i + 1, 1)") == "0") & (at_most >= F.col("least"))
        grown = grown.filter(new).drop("core", "least")
        shared = grown.groupBy("key", "i", "value").agg(F.sum("n").alias("n"), F.max("asks").alias("asks"))
        shared = shared.filter((F.col("n") >= k) & F.col("asks"))
        found = listed(grown, shared, ["key", "i", "value"], next=F.monotonically_increasing_id())
        if not found.rows:
            break
        joined, prefix = found.attach(grown, "grow")
        members = joined.filter(F.col(f"{prefix}next").isNotNull()).select(
            F.col(f"{prefix}next").alias("key"), F.col("mask").alias("parent"), "i", "cid", "n", "asks", "values"
        )
        members = stored(members)
        closed = members.groupBy("key").agg(F.first("parent").alias("parent"), F.first("i").alias("core"), _closure(width).alias("mask"))
        first_met = F.expr("substring(mask, 1, core) = substring(parent, 1, core)")
        closed = stored(closed.filter(first_met).select("key", "core", "mask", _ones(F.col("mask")).alias("size")))
        asking = members.filter("asks").select("key", "cid")
        met = asking.join(closed, "key").select("cid", "size", "mask")
        best = best.unionByName(met).groupBy("cid").agg(F.max(F.struct("size", "mask")).alias("best"))
        best = stored(best.select("cid", "best.size", "best.mask"))
        least = asking.join(best, "cid").groupBy("key").agg(F.min("size").alias("least"))
        reach = F.col("size") + F.length(F.translate(F.expr("substring(mask, core + 2)"), "1", ""))
        going = closed.join(least, "key").filter((reach >= F.col("least")) & (reach > F.col("size")))
        going = listed(members, going, ["key"], mask=F.col("mask"), core=F.col("core"), least=F.col("least"))
        if not going.rows:
            break
        joined, prefix = going.attach(members.drop("parent", "i"), "go on")
        kept = [F.col(f"{prefix}{c}").alias(c) for c in ("mask", "core", "least")]
        groups = joined.filter(F.col(f"{prefix}core").isNotNull()).select("key", *kept, "cid", "n", "asks", "values")
    return best.select("cid", "mask")


def local_suppression(df: DataFrame, qis: Sequence[str], k: int, importance: Sequence[str] | None = None) -> DataFrame:
    """Blank quasi-identifiers until every row agrees with at least ``k`` rows.

    The decision is made per class, not per row: the table is first reduced to its distinct
    classes with their sizes, and a class below ``k`` keeps the largest subset of its columns that
    at least ``k`` rows share; among subsets of one size the one that keeps the most important
    columns, those named in ``importance`` before the others.  If no subset does, all its columns go.  All rows sharing the kept values still match
    one another under NULL-as-wildcard, so the result is k-anonymous in that sense.

    Most classes need to lose one column only, which is looked at first.  For the others shared subsets
    are grown from the bottom, closed set by closed set (see ``_largest_shared``), so neither a class that shares
    nothing nor one that shares nearly all of many columns has its subsets written out, and sets of columns are as wide as need
    be.  Each step writes the rows of the groups that go on; how many there are depends on the data: at most the closed
    sets, shared by ``k`` rows, of the pending classes.  The search runs as the plan is built, and its
    tables lie in the checkpoint folder.
    """
    require_batch(df, "local suppression")
    check_columns(df.columns, list(qis), "quasi-identifier")
    check_columns(qis, list(importance or ()), "ranked")
    ranked = list(dict.fromkeys([*(importance or ()), *qis]))
    rank, width = {q: ranked.index(q) for q in qis}, len(ranked)
    own = [f"v_{i}" for i in range(width)]
    counted = df.select(*[F.col(f"`{q}`").alias(v) for q, v in zip(ranked, own, strict=True)]).groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    texts = [marked(lossless(F.col(v), df.schema[q].dataType)) for q, v in zip(ranked, own, strict=True)]
    classes = stored(counted.select(F.monotonically_increasing_id().alias("cid"), "n", F.array(*texts).alias("values"), *own))
    few = classes.select("cid", "n", "values")
    pending = few.filter(F.col("n") < k)
    picks = pending.select("cid", F.lit("0" * width).alias("mask"))
    if width > 1 and not pending.isEmpty():
        picks = _without_one(few, pending, k)
        rest = stored(pending.join(picks, "cid", "left_anti"))
        if not rest.isEmpty():
            picks = picks.unionByName(_largest_shared(few, rest, k, width))
    names = [F.col(v).alias(q) for q, v in zip(ranked, own, strict=True)]
    mask = f"{prefix_free_in(ranked)}mask"
    decided = classes.select("cid", *own).join(picks, "cid").select(*names, F.col("mask").alias(mask))
    picked, prefix = listed(df, decided, ranked, mask=F.col(mask)).attach(df, "blank", null_safe=True)

    def keep(q: str) -> Column:
        mask = F.col(f"{prefix}mask")
        stays = mask.isNull() | (F.substring(mask, rank[q] + 1, 1) == "1")
        return F.when(stays, F.col(f"`{q}`")).alias(q)

    return picked.select(*[keep(c) if c in rank else F.col(f"`{c}`") for c in df.columns])


def sentinel_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn the whole-number sentinel of missing values back into NULL in the numeric columns."""
    numeric = {c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)}
    return df.select(
        *[
            F.nullif(F.col(f"`{c}`"), F.lit(INTEGER_SENTINEL)).alias(c) if c in numeric else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def only_qis(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """The quasi-identifiers alone."""
    return df.select(*[F.col(f"`{q}`") for q in qis])
