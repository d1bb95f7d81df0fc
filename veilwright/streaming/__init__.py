"""What may run on a stream: the stateless column rewrites only."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_batch(df: DataFrame, what: str) -> None:
    """Class statistics need the whole table, so they refuse an unbounded input."""
    if df.isStreaming:
        raise ValueError(f"{what} needs a batch table: equivalence classes are undefined on a stream")


def generalize_stream(stream: DataFrame, rules) -> DataFrame:
    """Layered rules on a stream: the same projection as on a table."""
    from veilwright.operators.generalize import generalize

    if not stream.isStreaming:
        raise ValueError("generalize_stream takes a streaming table; use generalize for a batch one")
    return generalize(stream, rules)
