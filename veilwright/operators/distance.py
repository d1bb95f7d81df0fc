"""How far the sensitive values of a class are from the whole table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.operators.classes import count_profile, global_shares, own_shares
from veilwright.operators.lineage import stored
from veilwright.operators.matching import attach, cols
from veilwright.spec import check_free


# Fixed value: decimals a distance keeps.
DECIMALS = 12
#: Ranges of an octave of shares, and of all levels, in which points are merged with the global steps.
OCTAVE_RANGES, LEVEL_RANGES = 64, 4096
#: What the area beside a flat piece of a class depends on.
SHAPE = ["start", "stop", "level"]


def _settled(total: Column) -> Column:
    """A sum without the noise of the order in which its terms arrive.

    Tasks deliver in any order, so the last bits of a sum of doubles change from run to run.
    A class exactly at the threshold must not be judged now one way and now the other.
    """
    return F.round(total, DECIMALS)


def _share_steps(base: DataFrame, sensitive: str) -> DataFrame:
    """Step function of the global shares: ``share``, ``level`` reached there, ``area`` so far.

    Equal shares form one step.  Distinct counts of N rows are distinct whole numbers adding
    up to at most N, so there are at most sqrt(2N) steps: 1.4 million for 10^12 rows.  That
    bound is why the steps may be ordered in one task.
    """
    known = base.filter(F.col(f"`{sensitive}`").isNotNull()).select(F.col(f"`{sensitive}`").alias("value"))
    counted = known.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    steps = counted.groupBy("n").agg(F.count(F.lit(1)).alias("values"))
    order = Window.orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = steps.select(
        "n",
        (F.col("n") / F.sum(F.col("n") * F.col("values")).over(everything)).alias("share"),
        (F.sum("values").over(upto) / F.sum("values").over(everything)).alias("level"),
    )
    gained = F.lag("level", 1, 0.0).over(order) * (F.col("share") - F.lag("share", 1, 0.0).over(order))
    return steps.select("share", "level", gained.alias("gained"), "n").select(
        "share", "level", F.sum("gained").over(upto).alias("area")
    )


def _latest(points: DataFrame, steps: DataFrame, place: Callable[[Column], Column], last: int) -> DataFrame:
    """(``at``, ``found``): what the last step at or before each point holds, NULL where there is none.

    Points and steps have their position in ``at``, no two alike, and steps what they hold in ``found``.  They are
    merged range by range: ``place`` gives the range of a position, rising with it up to ``last``.  A range begins
    with the last step before it, so none has to look at another.
    """
    steps = steps.select(place(F.col("at")).alias("range"), "at", "found", F.lit(False).alias("asked"))
    ends = steps.groupBy("range").agg(F.max_by("found", "at").alias("found"))
    reach = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.lit(last).cast("bigint"))
    heads = ends.withColumn("reach", reach).filter(F.col("range") < F.col("reach"))
    heads = heads.select(
        F.explode(F.sequence(F.col("range") + 1, "reach")).alias("range"),
        F.lit(None).cast("double").alias("at"),
        "found",
        F.lit(False).alias("asked"),
    )
    nothing = F.lit(None).cast(steps.schema["found"].dataType)
    points = points.select(place(F.col("at")).alias("range"), "at", nothing.alias("found"), F.lit(True).alias("asked"))
    order = Window.partitionBy("range").orderBy(F.col("at").asc_nulls_first(), "asked")
    before = F.last("found", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = heads.union(steps).union(points).withColumn("found", before)
    return merged.filter("asked").select("at", "found")


def _level_range(at: Column) -> Column:
    return F.floor(at * LEVEL_RANGES)


def _share_range(at: Column) -> Column:
    return F.floor(F.log2(at) * OCTAVE_RANGES)


def _piece_areas(shapes: DataFrame, steps: DataFrame) -> DataFrame:
    """(``start``, ``stop``, ``level``, ``piece``, ``lead_in``): area between a flat piece and the global function,
    and the area under the global function before it."""
    levels = steps.select((-F.col("level")).alias("at"), F.col("share").alias("found"))
    wanted = shapes.withColumn("at", -F.col("level"))
    # the share at which the global function reaches the level of the piece
    meeting = _latest(wanted.select("at").distinct(), levels, _level_range, -1)
    cross = F.greatest("start", F.least("stop", F.coalesce("found", F.lit(1.0)))).alias("cross")
    crossed = stored(attach(wanted, meeting, ["at"], ["found"]).select(*SHAPE, cross))  # read twice below
    corners = crossed.select("*", F.posexplode(F.array("start", "cross", "stop")).alias("corner", "at"))
    shares = steps.select(F.col("share").alias("at"), F.struct("share", "level", "area").alias("found"))
    met = _latest(corners.select("at").distinct(), shares, _share_range, 0)
    below = F.col("found.area") + F.col("found.level") * (F.col("at") - F.col("found.share"))
    below = met.select("at", F.coalesce(below, F.lit(0.0)).alias("below"))
    areas = attach(corners, below, ["at"], ["below"]).groupBy(*SHAPE, "cross")
    areas = areas.agg(*[F.max(F.when(F.col("corner") == i, F.col("below"))).alias(f"at_{i}") for i in range(3)])
    before = F.col("level") * (F.col("cross") - F.col("start")) - (F.col("at_1") - F.col("at_0"))
    after = (F.col("at_2") - F.col("at_1")) - F.col("level") * (F.col("stop") - F.col("cross"))
    return areas.select(*SHAPE, (before + after).alias("piece"), F.col("at_0").alias("lead_in"))


def share_distance(
    df: DataFrame, base: DataFrame, qis: Sequence[str], sensitive: str, counted: DataFrame | None = None
) -> DataFrame:
    """(class, ``distance``, ``class_size``, ``nulls``): Wasserstein-1 distance of two *samples of shares*.

    The shares of the values in the class and the shares of the values in ``base`` are each
    taken as a sample of numbers in [0, 1]; values are not aligned.  The distance is the area
    between the two empirical step functions.  Between two neighbouring class shares the class
    function is flat at some level, so the area there follows from the global area function
    and the one point where the global function crosses that level.  No class is paired with
    global values: pieces of one shape, of which classes of like counts have many, are looked up
    once, in a merge of two sorted tables range by range.

    The pieces, their shapes and the steps, all out of aggregates, are written down as the plan is built, so each table is
    counted once and each merge made once.
    """
    mine = Window.partitionBy(*cols(qis)).orderBy(F.col("__n").asc_nulls_first())
    upto = mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    profile = count_profile(df, qis, sensitive, counted).withColumn("__rows", F.col("__n") * F.col("__values"))
    names = [f"key_{i}" for i in range(len(qis))]
    flat = profile.select(
        *[c.alias(name) for c, name in zip(cols(qis), names, strict=True)],
        "__n",
        F.lag("__n").over(mine).alias("lower"),
        F.lead("__n").over(mine).alias("higher"),
        F.sum("__values").over(upto).alias("reached"),
        F.sum("__values").over(whole).alias("all_values"),
        F.sum("__rows").over(whole).alias("known_rows"),
        F.sum("__unknown").over(whole).alias("nulls"),
    ).filter(F.col("__n").isNotNull())
    flat = stored(
        flat.select(
            *names,
            (F.col("__n") / F.col("known_rows")).alias("start"),
            F.coalesce(F.col("higher") / F.col("known_rows"), F.lit(1.0)).alias("stop"),
            (F.col("reached") / F.col("all_values")).alias("level"),
            F.col("lower").isNull().alias("lowest"),
            "known_rows",
            "nulls",
        )
    )
    areas = _piece_areas(flat.select(*SHAPE).distinct(), stored(_share_steps(base, sensitive)))
    measured = attach(flat, areas, SHAPE, ["piece", "lead_in"])
    area = F.when(F.col("lowest"), F.col("lead_in")).otherwise(0.0) + F.col("piece")
    return (
        measured.groupBy(*names)
        .agg(
            _settled(F.sum(area)).alias("distance"),
            F.first(F.col("known_rows") + F.col("nulls")).alias("class_size"),
            F.first("nulls").alias("nulls"),
        )
        .withColumnsRenamed(dict(zip(names, qis, strict=True)))
    )


def _aligned(
    df: DataFrame, base: DataFrame, qis: Sequence[str], sensitive: str, counted: DataFrame | None = None
) -> DataFrame:
    value = F.col(f"`{sensitive}`")
    world = global_shares(base.select(value.alias("value")), "value")
    world = world.select(F.col("value").alias(sensitive), F.col("share").alias("__global"))
    return attach(own_shares(df, qis, [sensitive], counted), world, [sensitive], ["__global"])


def kl_divergence(
    df: DataFrame, base: DataFrame, qis: Sequence[str], sensitive: str, counted: DataFrame | None = None
) -> DataFrame:
    """(class, ``distance``): sum of p ln(p / q) over the values of the class, natural log.

    A value absent from the class adds nothing, and every value of the class that occurs in
    ``base`` has a positive global share, so only class values are looked at.
    """
    p, q = F.col("__share"), F.col("__global")
    shares = _aligned(df, base, qis, sensitive, counted)
    return shares.groupBy(*cols(qis)).agg(_settled(F.sum(p * F.log(p / q))).alias("distance"))


def l1_distance(
    df: DataFrame, base: DataFrame, qis: Sequence[str], sensitive: str, counted: DataFrame | None = None
) -> DataFrame:
    """(class, ``distance``): sum of |q - p| over the values of ``base``.

    Values absent from the class add their own global share; all global shares add up to 1,
    so they are accounted for by ``1 - (global share of the values present)``.
    """
    p, q = F.col("__share"), F.col("__global")
    return (
        _aligned(df, base, qis, sensitive, counted).groupBy(*cols(qis)).agg(_settled(F.lit(1.0) + F.sum(F.abs(q - p) - q)).alias("distance"))
    )


DISTANCES = {"shares": share_distance, "kl": kl_divergence, "l1": l1_distance}


def class_distance(df: DataFrame, base: DataFrame, qis: Sequence[str], sensitive: str, kind: str = "shares") -> DataFrame:
    if kind not in DISTANCES:
        raise ValueError(f"unknown distance {kind!r}; choose one of {', '.join(DISTANCES)}")
    check_free(qis, ["distance", "class_size", "nulls"])
    return DISTANCES[kind](df, base, qis, sensitive)
