"""Numbers and moments as text, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def number_text(value: Column) -> Column:
    """A double as plain text: positional from 1e-4 up to 1e16, as in ``39848009.0``.

    The engine's own cast turns to ``3.9848009E7`` from 1e7 on, which would split
    one number into two labels depending on which tool printed it.
    """
    number = value.cast("double")
    size = F.abs(number)
    # a decimal keeps the shortest digits of the double; only its zero padding has to go
    plain = F.regexp_replace(number.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(number.cast("string"), r"(\.0)?E(-?)", "e$2")
    power = F.regexp_replace(F.regexp_replace(power, r"e(\d)", "e+$1"), r"e([+-])(\d)$", "e$10$2")
    shown = number.cast("string")
    return (
        F.when(~shown.contains("E"), shown).when((size >= 1e-4) & (size < 1e16), plain).otherwise(power)
    )


def whole_text(value: Column) -> Column:
    """The integer part of a number as text, cut toward zero."""
    return value.cast("bigint").cast("string")


def day_text(micros: Column) -> Column:
    """``YYYY-MM-DD`` of a wall-clock microsecond count."""
    return F.date_from_unix_date(F.floor(micros / DAY_MICROS).cast("int")).cast("string")


def moment_text(micros: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` with six decimals only when there is a fraction."""
    second = F.pmod(F.floor(micros / 1_000_000), F.lit(86_400))
    fraction = F.pmod(micros, F.lit(1_000_000))

    def two(part: Column) -> Column:
        return F.lpad(part.cast("bigint").cast("string"), 2, "0")

    clock = F.concat_ws(
        ":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60)
    )
    tail = F.when(fraction == 0, "").otherwise(
        F.concat(F.lit("."), F.lpad(fraction.cast("bigint").cast("string"), 6, "0"))
    )
    return F.concat(day_text(micros), F.lit(" "), clock, tail)


def timestamp_text(moment: Column) -> Column:
    """The same text, of a zone-free timestamp."""
    text = moment.cast("string")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
