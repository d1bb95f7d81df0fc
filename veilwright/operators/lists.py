"""Lists of classes that decide about rows, written once and measured before rows meet them.

A list out of an aggregate is known to be small only when it has been counted, and by then a plan has
written every row to the shuffle that a large list would need.  So a list is counted first: it is
written to the checkpoint folder as the plan is built, and its rows and bytes are read from there.

* Up to ``SMALL_BYTES`` it is broadcast, and no row is shuffled.
* Beyond that a Bloom filter of its keys (at most ``MOST_BITS`` bits, whatever the list holds) is put on the
  scan.  Rows that it rules out go straight to the result; only the others, the rows of the listed classes
  and a few by chance, are shuffled and joined, in a join whose hot classes AQE splits (see ``matching``).
* A list with more keys than the filter can tell apart is joined without one.

The rows that stay and those that are looked up are two scans of the input with opposite filters, so the input has
to give the same rows each time it is read, as it has to for everything else here that reads it twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.functions.chance import lossless, marked
from veilwright.operators.lineage import stored
from veilwright.operators.matching import all_of, cols, fingerprint

#: A list of at most so many bytes is broadcast.
SMALL_BYTES = 64 << 20
#: Bits of a filter for each key of the list, the most a filter has, and the fewest for a key that are of use.
KEY_BITS, MOST_BITS, LEAST_KEY_BITS = 16, 1 << 26, 4
#: A list with more key columns is joined on one text that holds all of them: the optimizer's inference of
#: further conditions from many equal columns grows out of bounds.
MOST_KEYS = 8
#: Bytes of a row beside its texts.
ROW_BYTES = 32
PROBES = ("first", "second", "third")


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.AtomicType):
        return F.lit(16)
    return F.octet_length(F.coalesce(F.to_json(F.struct(column)), F.lit(""))) + 16


def prefix_free_in(names: Sequence[str]) -> str:
    """A prefix with which no column of ``names`` begins, whatever the case."""
    prefix = "__"
    while any(n.lower().startswith(prefix) for n in names):
        prefix = f"_{prefix}"
    return prefix


@dataclass(frozen=True)
class Listed:
    """A stored list: keys ``key_0``, ``key_1``, ... for the columns ``names``, and carried columns.

    With many columns there is one key, their text; ``kinds`` are their types.
    """

    table: DataFrame
    names: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    carried: tuple[str, ...]
    rows: int
    bytes: int

    @property
    def keys(self) -> list[str]:
        return [f"key_{i}" for i in range(1 if len(self.names) > MOST_KEYS else len(self.names))]

    def _own(self) -> list[Column]:
        """The keys of a row that is to be looked up."""
        return _keys(cols(self.names), self.kinds)

    @property
    def small(self) -> bool:
        return self.bytes <= SMALL_BYTES

    @cached_property
    def _bits(self) -> int:
        """Bits of the filter, a power of two; 0 where none is of use."""
        wanted = 1 << max(10, (self.rows * KEY_BITS - 1).bit_length())
        return min(wanted, MOST_BITS) if self.rows * LEAST_KEY_BITS <= MOST_BITS else 0

    def _places(self, mark: Column) -> list[Column]:
        """Places in the filter of a key by its ``mark``, one number."""
        return [F.pmod(fingerprint([mark], probe), F.lit(self._bits)) for probe in PROBES]

    @cached_property
    def _filter(self) -> DataFrame:
        """The words of the filter in one row."""
        marks = self.table.select(_mark(cols(self.keys)).alias("mark"))
        places = marks.select(F.explode(F.array(*self._places(F.col("mark")))).alias("place"))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int"))
        bits = places.select(F.floor(F.col("place") / 64).alias("word"), one.alias("bits"))
        none = self.table.sparkSession.range(self._bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        words = bits.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        every = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
        return stored(words.agg(every.alias("words")))

    def maybe(self, mark: Column | None = None) -> Column:
        """Whether a row may be of a listed class: no row of one is ever ruled out.

        ``mark`` is the mark of its key where a column has that already.
        """
        words = self._filter.scalar()
        tests = [
            F.getbit(F.get(words, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1
            for place in self._places(_mark(self._own()) if mark is None else mark)
        ]
        return all_of(tests)

    def _sifted(self, rows: DataFrame, may_be: bool = True) -> DataFrame:
        """The rows that may be of a listed class, or the others.

        A test on columns is pushed below the projection that makes them and makes them again for every
        place it looks at; labels of moments take longer than all the rest.  The mark is therefore made by a generator of
        one row, which no test is pushed through: labels are made once for each row.
        """
        mark = f"{prefix_free_in(rows.columns)}mark"
        test = self.maybe(F.col(mark))
        once = rows.select("*", F.stack(F.lit(1), _mark(self._own())).alias(mark))
        return once.filter(test if may_be else ~test).select(*cols(rows.columns))

    def beside(self, rows: DataFrame, join: object, null_safe: bool = False) -> tuple[DataFrame, Column, str]:
        """The list under names that are free in ``rows``, what a row of it agrees in, and the prefix of the names."""
        prefix = prefix_free_in(rows.columns)
        side = self.table.select(
            fingerprint(cols(self.keys), join).alias(f"{prefix}print"),
            *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in (*self.keys, *self.carried)],
        )
        own = self._own()
        pairs = [(a, F.col(f"{prefix}{k}")) for a, k in zip(own, self.keys, strict=True)]
        equal = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
        if len(own) < len(self.names) and not null_safe:  # the text is never NULL
            equal += [c.isNotNull() for c in cols(self.names)]
        return side, all_of([fingerprint(own, join) == F.col(f"{prefix}print"), *equal]), prefix

    def renewed(self, table: DataFrame, carried: Sequence[str]) -> Listed:
        """Another list of the same keys, written and measured."""
        return _measured(table, self.names, self.kinds, carried)

    def only(self, rows: DataFrame, join: object, null_safe: bool = False) -> DataFrame:
        """The rows of the listed classes."""
        side, same, _ = self.beside(rows, join, null_safe)
        if self.small:
            return rows.join(F.broadcast(side), same, "left_semi")
        return (self._sifted(rows) if self._bits else rows).join(side, same, "left_semi")

    def without(self, rows: DataFrame, join: object, null_safe: bool = False, gone: Mapping[str, Column] | None = None) -> DataFrame:
        """All rows but those of the listed classes.

        ``gone`` maps carried limits to columns of the row: a row goes only if one of the columns is at most its limit.
        """
        side, same, prefix = self.beside(rows, join, null_safe)
        if gone:
            hit = F.lit(False)
            for limit, column in gone.items():
                hit = hit | F.coalesce(column <= F.col(f"{prefix}{limit}"), F.lit(False))
            same = same & hit
        if self.small:
            return rows.join(F.broadcast(side), same, "left_anti")
        if not self._bits:
            return rows.join(side, same, "left_anti")
        looked_up = self._sifted(rows).join(side, same, "left_anti")
        return self._sifted(rows, False).union(looked_up)

    def attach(self, rows: DataFrame, join: object, null_safe: bool = False) -> tuple[DataFrame, str]:
        """All rows with the carried columns, NULL where the class is not listed, and the prefix of their names."""
        side, same, prefix = self.beside(rows, join, null_safe)
        carried = [f"{prefix}{c}" for c in self.carried]

        def joined(part: DataFrame) -> DataFrame:
            table = F.broadcast(side) if self.small else side
            return part.join(table, same, "left").select(*cols(rows.columns), *cols(carried))

        if self.small or not self._bits:
            return joined(rows), prefix
        types = {f.name: f.dataType for f in self.table.schema}
        apart = self._sifted(rows, False).select("*", *[F.lit(None).cast(types[c]).alias(f"{prefix}{c}") for c in self.carried])
        return apart.union(joined(self._sifted(rows))), prefix


def _mark(keys: Sequence[Column]) -> Column:
    return fingerprint(keys, "mark")


def _keys(columns: Sequence[Column], kinds: Sequence[T.DataType]) -> list[Column]:
    """The columns themselves, or if they are many one text that holds them all."""
    if len(columns) <= MOST_KEYS:
        return list(columns)
    return [F.concat(F.lit(""), *[marked(lossless(c, kind)) for c, kind in zip(columns, kinds, strict=True)])]


def listed(rows: DataFrame, classes: DataFrame, names: Sequence[str], **carried: Column) -> Listed:
    """Write the classes down as a list for ``rows``, and measure it."""
    kinds = [rows.schema[n].dataType for n in names]
    keys = _keys([F.col(f"`{n}`").cast(kind) for n, kind in zip(names, kinds, strict=True)], kinds)
    own = classes.select(*[k.alias(f"key_{i}") for i, k in enumerate(keys)], *[c.alias(name) for name, c in carried.items()])
    return _measured(own, names, kinds, list(carried))


def _measured(table: DataFrame, names: Sequence[str], kinds: Sequence[T.DataType], carried: Sequence[str]) -> Listed:
    table = stored(table)
    size = F.lit(ROW_BYTES)
    for field in table.schema:
        size = size + _bytes(F.col(field.name), field.dataType)
    found = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).collect()[0]
    return Listed(table, tuple(names), tuple(kinds), tuple(carried), found["rows"], found["bytes"])
