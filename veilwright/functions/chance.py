"""Random numbers as column expressions.

Two kinds.  ``random`` draws from the engine's generator: fast, but a row's draw depends on
its partition.  ``hash`` derives the draw from a secret salt and the row's key: the same row
always gets the same draw, so a recomputed task repeats it exactly.  Whoever knows the salt
can undo hash noise, so it must stay secret in production.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType

# 13 hex digits of an MD5 text hold 52 bits, as many as a double keeps.
HEX_DIGITS = 13
SPREAD = float(2**52)


def marked(text: Column) -> Column:
    """A text with its length before it, or a dash for NULL: such parts can be strung together safely."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def key_text(columns: Sequence[str]) -> Column:
    """Key columns as one text that no other key shares; NULL is told apart from empty text."""
    return F.concat(F.lit(""), *[marked(F.col(f"`{c}`").cast("string")) for c in columns])


def lossless(value: Column, kind: DataType) -> Column:
    """A text that no other value of this type shares, whatever the session's settings; NULL for NULL."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(value)
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(value, lambda x: marked(lossless(x, kind.elementType))), "")
    if isinstance(kind, StructType):
        parts = [marked(lossless(value.getField(f.name), f.dataType)) for f in kind]
        return F.when(value.isNotNull(), F.concat(F.lit(""), *parts))
    if isinstance(kind, MapType):
        pair = StructType().add("key", kind.keyType).add("value", kind.valueType)
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: marked(lossless(e, pair))))
        return F.array_join(entries, "")
    return value.cast("string")


def content_text(df: DataFrame) -> Column:
    """All columns of a row as one text that only equal rows share."""
    return F.concat(F.lit(""), *[marked(lossless(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema])


def keyed_hash(salt: object, columns: Sequence[str]) -> Column:
    """32 hex digits that order rows by chance, the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(salt)), key_text(columns)))


def hash_bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Chance:
    """A source of independent draws, told apart by name."""

    kind: str = "random"
    seed: int = 42
    key: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("random", "hash"):
            raise ValueError(f"noise must be 'random' or 'hash', got {self.kind!r}")
        if self.kind == "hash" and not self.key:
            raise ValueError("hash noise needs key columns that identify a row")

    def _salted(self, name: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(name), key_text(self.key or ())))

    def _own_seed(self, name: str) -> int:
        # 63 bits of a digest: the engine counts seeds up by partition, so near seeds would share streams
        return int.from_bytes(hashlib.sha256(f"{self.seed}|{name}".encode()).digest()[:8], "big") >> 1

    def uniform(self, name: str) -> Column:
        """Strictly between 0 and 1."""
        if self.kind == "random":
            return F.greatest(F.rand(self._own_seed(name)), F.lit(2.0**-54))
        return (hash_bits(self._salted(name)) + F.lit(0.5)) / F.lit(SPREAD)

    def laplace(self, name: str, scale: float) -> Column:
        """The difference of two exponential draws: each uniform is used once, so none is repeated."""
        return (F.log(self.uniform(f"{name}/minus")) - F.log(self.uniform(f"{name}/plus"))) * F.lit(scale)

    def gaussian(self, name: str, sd: float) -> Column:
        if self.kind == "random":
            return F.randn(self._own_seed(name)) * F.lit(sd)
        radius = F.sqrt(F.lit(-2.0) * F.log(self.uniform(f"{name}/radius")))
        return radius * F.cos(F.lit(2 * math.pi) * self.uniform(f"{name}/angle")) * F.lit(sd)

def gaussian_sd(epsilon: float, delta: float) -> float:
    """Standard deviation of the Gaussian mechanism at sensitivity 1."""
    return math.sqrt(2 * math.log(1.25 / delta)) / epsilon
