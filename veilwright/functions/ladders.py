"""Chained ranges: the first range that holds a value gives its label."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.spec import DateLayer, NumberLayer


def first_match(cases: Iterable[tuple[Column, Column]], otherwise: Column | None) -> Column:
    """``CASE WHEN`` over the given tests in order."""
    chain: Column | None = None
    for test, label in cases:
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    if chain is None:
        return F.lit(None).cast("string") if otherwise is None else otherwise
    return chain if otherwise is None else chain.otherwise(otherwise)


def number_ladder(value: Column, layers: Sequence[NumberLayer], otherwise: Column) -> Column:
    """Label by inclusive numeric ranges."""
    return first_match(((value.between(x.low, x.high), F.lit(x.label)) for x in layers), otherwise)


def date_ladder(moment: Column, layers: Sequence[DateLayer], otherwise: Column) -> Column:
    """Label by inclusive ranges of zone-free timestamps."""

    def bound(at: object) -> Column:
        return F.lit(f"{at:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz")

    return first_match(
        ((moment.between(bound(x.low), bound(x.high)), F.lit(x.label)) for x in layers), otherwise
    )
