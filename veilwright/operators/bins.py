"""Generalisers whose bins come from the data.

Each returns a ``Column``.  The few numbers a bin ladder needs (minimum, maximum, mean) are
scalar subqueries: one small aggregate over a pruned scan, evaluated with the query itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.ladders import first_match
from veilwright.functions.text import DAY_MICROS, day_text, moment_text, whole_text
from veilwright.functions.values import as_moment, as_number, wall_micros
from veilwright.spec import GENERAL, UNKNOWN
from veilwright.streaming import require_batch

# Most edges of the equal-width bins, intervals and decades of the others,
# and the day spans that choose the number of adaptive date bins.
MAX_EDGES = 4
EQUAL_DATE_BINS = 5
DECADE = 10
ADAPTIVE_SPANS = ((365, 2), (365 * 5, 4), (365 * 10, 6))
ADAPTIVE_MOST = 8
OUTLIER_SDS = 3


def ladder_of(bounds: Column, labels: Column) -> Column:
    """Bounds and labels of a ladder with one label more than bounds, as a struct for ``place``."""
    return F.struct(bounds.alias("bounds"), F.reverse(labels).alias("labels"))


def place(value: Column, ladder: Column) -> Column:
    """The label of ``value``: as many labels are skipped as bounds are reached.

    In descending order the value stands right behind the bounds it does not reach, so its
    position picks from the reversed labels.  Written so that the scalar subquery behind
    ``ladder`` is used twice only and everything stays in generated code.
    """
    unreached = F.array_position(F.sort_array(F.array_append(ladder["bounds"], value), asc=False), value) - 1
    return F.get(ladder["labels"], unreached)


def equal_widths(df: DataFrame, names: Sequence[str], null_bin: str = "null") -> dict[str, Column]:
    """At most three equal bins for each column, left-closed, the maximum in the last; label ``lo-hi``.

    ``null_bin`` says where NULL goes: ``'last'``, ``'first'`` or ``'null'``.  In the first
    two modes NULL also counts as a value when the number of edges is fixed.

    How many edges there are depends on the distinct values, but only up to four of them.
    Two min/max passes answer that without a distinct count, which would shuffle every value:
    strictly between the extremes lie none, one or more.  Each pass looks at all columns at once, and all
    ladders come out of one small table, so the number of scans does not grow with the columns.
    """
    require_batch(df, "data-driven bins")
    if null_bin not in ("last", "first", "null"):
        raise ValueError(f"null_bin must be 'last', 'first' or 'null', got {null_bin!r}")
    if not names:
        return {}
    numbers = {name: as_number(df, name).cast("double") for name in names}
    own = [f"v_{i}" for i in range(len(names))]
    values = df.select(*[number.alias(v) for number, v in zip(numbers.values(), own, strict=True)])

    def limits(v: str) -> Column:
        gaps = F.count(v) < F.count(F.lit(1))
        return F.struct(F.min(v).alias("low"), F.max(v).alias("high"), gaps.alias("gaps")).alias(v)

    outer = values.agg(F.struct(*[limits(v) for v in own])).scalar()
    between = values.select(*[F.when((F.col(v) > outer[v]["low"]) & (F.col(v) < outer[v]["high"]), F.col(v)).alias(v) for v in own])
    found = between.agg(*[F.struct(F.min(v).alias("a"), F.max(v).alias("b")).alias(v) for v in own])
    found = found.select(*own, F.lit(outer).alias("outer"))

    def ladder(v: str) -> Column:
        a, b, low, high, gaps = (F.col(f"{v}.a"), F.col(f"{v}.b"), *(F.col(f"outer.{v}.{x}") for x in ("low", "high", "gaps")))
        inner = F.when(a.isNull(), 0).when(a == b, 1).otherwise(2)
        distinct = F.when(low == high, 1).otherwise(2 + inner)
        if null_bin != "null":
            distinct = distinct + gaps.cast("int")
        bins = F.greatest(F.lit(1), F.least(distinct, F.lit(MAX_EDGES)) - 1)
        step = (high - low) / bins

        def edge(i: Column) -> Column:
            return F.when(i == bins, high).otherwise(low + step * i)

        order = F.sequence(F.lit(1), bins)
        labels = F.transform(order, lambda i: F.concat(whole_text(edge(i - 1)), F.lit("-"), whole_text(edge(i))))
        bounds = F.slice(F.transform(order, edge), F.lit(1), bins - 1)
        missing = {"last": F.element_at(labels, -1), "first": F.element_at(labels, 1), "null": F.lit(None).cast("string")}
        return F.struct(ladder_of(bounds, labels).alias("ladder"), missing[null_bin].alias("missing")).alias(v)

    ladders = found.select(F.struct(*[ladder(v) for v in own])).scalar()
    placed = {}
    for (name, number), v in zip(numbers.items(), own, strict=True):
        label = place(number, ladders[v]["ladder"])
        placed[name] = label if null_bin == "null" else F.coalesce(label, ladders[v]["missing"])
    return placed


def equal_width(df: DataFrame, name: str, null_bin: str = "null") -> Column:
    """The bins of one column; see ``equal_widths``."""
    return equal_widths(df, [name], null_bin)[name]


def _limits(df: DataFrame, value: Column) -> Column:
    return df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()


def decade(df: DataFrame, name: str) -> Column:
    """Right-closed bins of ten, the lowest edge included; label ``a-b``."""
    require_batch(df, "data-driven bins")
    value = as_number(df, name).cast("double")
    return decade_label(value, _limits(df, value))


def decade_label(value: Column, limits: Column) -> Column:
    """Decade of ``value`` within the decades that span ``limits``; NULL outside of them."""
    low = F.floor(limits["low"] / DECADE) * DECADE
    high = F.greatest(F.ceil(limits["high"] / DECADE) * DECADE, low + DECADE)
    top = F.greatest(F.ceil(value / DECADE) * DECADE, low + DECADE)
    text = F.concat((top - DECADE).cast("bigint").cast("string"), F.lit("-"), top.cast("bigint").cast("string"))
    return F.when((value >= low) & (value <= high), text)


def quarter(df: DataFrame, name: str) -> Column:
    """``Q1`` to ``Q4``; an unknown date gives the unknown marker."""
    return F.coalesce(F.concat(F.lit("Q"), F.quarter(as_moment(df, name)).cast("string")), F.lit(UNKNOWN))


def year(df: DataFrame, name: str) -> Column:
    """The year; an unknown date takes the earliest year of the column."""
    require_batch(df, "data-driven bins")
    own = F.year(as_moment(df, name))
    earliest = df.agg(F.min(own)).scalar()
    return F.coalesce(own, earliest).cast("string")


def dates_equal(df: DataFrame, name: str, bins: int = EQUAL_DATE_BINS) -> Column:
    """Equal half-open intervals between the first and the last moment.

    The last moment itself lies in no interval and becomes NULL; an unknown date gives the
    unknown marker.  Labels carry full timestamps.
    """
    require_batch(df, "data-driven bins")
    moment = as_moment(df, name)
    micros = wall_micros(moment)
    span = df.agg(F.min(micros).alias("low"), F.max(micros).alias("high"))

    def edge(i: Column) -> Column:
        return F.col("low") + F.floor((F.col("high") - F.col("low")) * i / bins)

    order = F.sequence(F.lit(1), F.lit(bins))
    labels = F.transform(order, lambda i: F.concat(moment_text(edge(i - 1)), F.lit(" - "), moment_text(edge(i))))
    # the top edge is a bound as well, and what reaches it has no label
    labels = F.array_append(labels, F.lit(None).cast("string"))
    ladder = span.select(ladder_of(F.transform(order, edge), labels)).scalar()
    return F.when(micros.isNull(), UNKNOWN).otherwise(place(micros, ladder))


def dates_adaptive(df: DataFrame, name: str) -> Column:
    """Two to eight equal date intervals, depending on the span without outliers.

    Mean and deviation are taken over the distinct moments; those further than three
    deviations out do not widen the span and fall into the last interval, on either side.
    An unknown date takes the first interval.
    """
    require_batch(df, "data-driven bins")
    micros = wall_micros(as_moment(df, name))
    moments = df.select(micros.alias("at")).filter(F.col("at").isNotNull()).distinct()
    # seconds keep mean and deviation well inside what a double resolves
    second = F.col("at") / 1_000_000
    centre = moments.agg(F.avg(second).alias("mean"), F.coalesce(F.stddev_samp(second), F.lit(0.0)).alias("sd"))
    reach = F.col("sd") * OUTLIER_SDS
    usual = centre.select(
        F.struct((F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high"))
    ).scalar()
    span = moments.filter(second.between(usual["low"], usual["high"])).agg(
        F.min("at").alias("low"), F.max("at").alias("high")
    )
    days = F.floor((F.col("high") - F.col("low")) / DAY_MICROS)
    bins = first_match(((days <= most, F.lit(count)) for most, count in ADAPTIVE_SPANS), F.lit(ADAPTIVE_MOST))
    span = span.withColumn("bins", bins)

    def edge(i: Column) -> Column:
        return F.floor((F.col("low") + F.floor((F.col("high") - F.col("low")) * i / F.col("bins"))) / 1_000_000)

    def label(i: Column) -> Column:
        return F.concat(day_text(edge(i - 1) * 1_000_000), F.lit(" - "), day_text(edge(i) * 1_000_000))

    order = F.sequence(F.lit(1), F.col("bins"))
    labels = F.transform(order, label)
    # every lower edge is a bound, so reaching none (a low outlier) leads to the label put in front
    bounds = F.transform(order, lambda i: edge(i - 1))
    ladder = span.select(
        F.struct(
            ladder_of(bounds, F.concat(F.array(F.element_at(labels, -1)), labels)).alias("ladder"),
            F.element_at(labels, 1).alias("missing"),
        )
    ).scalar()
    return F.coalesce(place(F.floor(micros / 1_000_000), ladder["ladder"]), ladder["missing"])


def general(label: str = GENERAL) -> Column:
    """One category for all."""
    return F.lit(label)
