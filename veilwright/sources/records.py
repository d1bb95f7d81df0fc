"""Writing results as JSON records, one object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.functions.values import wall_micros

DECIMALS = 10  # fixed value: digits kept of a fraction in epoch style


def _epoch_style(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.floor(wall_micros(column.cast("timestamp_ntz")) / 1000).alias(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.round(column, DECIMALS).alias(field.name)
    return column


def as_records(df: DataFrame, epoch: bool = False) -> DataFrame:
    """The table as records would show it: with ``epoch``, moments as milliseconds and rounded fractions."""
    return df.select(*[_epoch_style(f) for f in df.schema]) if epoch else df


def write_records(df: DataFrame, path: str, epoch: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines in a folder, written by all tasks at once; NULLs are kept as ``null``."""
    as_records(df, epoch).write.mode(mode).option("ignoreNullFields", False).json(path)
