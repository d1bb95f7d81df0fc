"""Joining rows with tables of classes or values, one of which may hold a third of all rows.

A class table comes out of an aggregate over the very columns it is joined on, so Spark would
reuse that partitioning and join without shuffling the class side again.  AQE, however, splits
an oversized partition of a sort-merge join only when *both* sides arrive fresh from a
shuffle.  Therefore every such join compares a fingerprint of the key columns as well: the
aggregate is not partitioned by it, the (far smaller) class side is shuffled once more, and a
hot class is split over many tasks.  For the same reason each join has a fingerprint of its
own: rows that come out of one such join are shuffled afresh for the next, or neither could be
split.  Where AQE finds the class side small only at run time, it broadcasts it, but the rows have been
written to the shuffle by then; ``lists`` counts first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(and_, tests)


def cols(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col(f"`{n}`") for n in names]


def fingerprint(columns: Sequence[Column], join: object) -> Column:
    return F.xxhash64(F.lit(str(join)), *columns)


def key_side(rows: DataFrame, keyed: DataFrame, names: Sequence[str], *carried: Column | str, join: object) -> DataFrame:
    """The key columns of ``keyed`` under names of their own, with their fingerprint and more columns."""
    keys = [F.col(f"`{n}`").cast(rows.schema[n].dataType) for n in names]
    return keyed.select(
        fingerprint(keys, join).alias("__print"), *[k.alias(f"__key_{i}") for i, k in enumerate(keys)], *carried
    )


def same_key(names: Sequence[str], join: object, null_safe: bool = False) -> Column:
    """Row and ``key_side`` agree; with ``null_safe`` NULL is a value like any other."""
    columns = cols(names)
    pairs = [(column, F.col(f"__key_{i}")) for i, column in enumerate(columns)]
    equal = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return all_of([fingerprint(columns, join) == F.col("__print"), *equal])


def attach(rows: DataFrame, keyed: DataFrame, names: Sequence[str], carried: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the ``carried`` columns of a table with one row per key."""
    side = key_side(rows, keyed, names, *carried, join="attach")
    return rows.join(side, same_key(names, "attach"), how).select(*cols(rows.columns), *cols(carried))
