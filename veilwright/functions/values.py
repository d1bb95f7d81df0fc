"""Reading a column as a number or a moment: what cannot be read becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.functions.text import number_text

# Text forms of a date tried after the ISO forms.
DATE_FORMATS = ("yyyy/M/d", "yyyy-M-d")

FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a number; integers stay integers, NaN and unreadable text become NULL."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return column
    if isinstance(kind, FRACTIONAL):
        value = column.cast("double")
    elif isinstance(kind, T.StringType):
        # a trailing type letter ("1.5f") is a number to the JVM but not to a reader
        value = F.when(~column.rlike(r"[dDfF]\s*$"), column).try_cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(value), value)


def number_or_nan(df: DataFrame, name: str) -> Column:
    """As ``as_number``, but NaN stays: enough for range tests, which NaN never passes."""
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return F.col(f"`{name}`").cast("double")
    return as_number(df, name)


def number_known(df: DataFrame, name: str) -> Column:
    """Whether ``as_number`` gives a number, in a form whose NULL test reaches the scan."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return column.isNotNull() & ~F.isnan(column.cast("double"))
    return as_number(df, name).isNotNull()


def number_as_read(df: DataFrame, name: str) -> Column:
    """The text a number keeps when no label replaces it."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return column.cast("string")
    if isinstance(kind, FRACTIONAL):
        return F.when(~F.isnan(column), number_text(column))
    text = number_text(as_number(df, name))
    if isinstance(kind, T.StringType):
        return F.when(column.rlike(r"^\s*[+-]?\d{1,18}\s*$"), column.try_cast("bigint").cast("string")).otherwise(text)
    return text


def as_moment(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The column as a zone-free timestamp."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        tries = [column.try_cast("timestamp_ntz")]
        tries += [F.try_to_timestamp(column, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
        return F.coalesce(*tries)
    if isinstance(kind, T.NumericType):  # nanoseconds since 1970
        seconds = (column / 1_000_000_000).cast("decimal(18,6)")
        zero = F.lit(0)
        return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.lit(None).cast("timestamp_ntz")


def wall_micros(moment: Column) -> Column:
    """Microseconds on the wall clock since 1970-01-01, whatever the session zone."""
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60
    return (
        F.unix_date(moment.cast("date")).cast("bigint") * 86_400_000_000
        + seconds.cast("bigint") * 1_000_000
        + (F.extract(F.lit("SECONDS"), moment) * 1_000_000).cast("bigint")
    )


def epoch_day(moment: Column) -> Column:
    """Whole days since 1970-01-01, rounded down."""
    return F.unix_date(moment.cast("date"))
