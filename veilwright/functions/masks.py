"""Masking of text: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.spec import MASKED, STAR


def mask_prefix(value: Column, pattern: str, null_as: str = MASKED) -> Column:
    """Keep as many leading characters as ``pattern`` has letters, then its stars.

    Only the counts matter.  A value no longer than the kept part turns into stars.
    """
    stars = pattern.count(STAR)
    kept = len(pattern) - stars
    text = value.cast("string")
    return (
        F.when(text.isNull(), null_as)
        .when(F.length(text) <= kept, F.repeat(F.lit(STAR), F.length(text)))
        .otherwise(F.concat(F.substring(text, 1, kept), F.lit(STAR * stars)))
    )


def mask_tail(
    value: Column, short: str | None = MASKED, null_as: str | None = MASKED, marker_stays: bool = True
) -> Column:
    """Replace the last two characters by stars.

    ``short`` is what a value of at most two characters becomes (``None`` keeps it) and
    ``null_as`` what a NULL becomes.  The marker text itself is cut only on request.
    """
    text = value.cast("string")
    cut = F.concat(F.left(text, F.length(text) - 2), F.lit(STAR * 2))
    brief = text if short is None else F.lit(short)
    masked = F.when(F.length(text) > 2, cut).otherwise(brief)
    if marker_stays:
        masked = F.when(text == MASKED, F.lit(MASKED)).otherwise(masked)
    return F.when(text.isNull(), F.lit(null_as)).otherwise(masked)


def mask_constant() -> Column:
    """The same marker for every row."""
    return F.lit(MASKED)
