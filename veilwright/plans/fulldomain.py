"""Full-domain generalisation: one hierarchy level per column for the whole table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain, combinations, islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.operators.hierarchy import levels_of
from veilwright.operators.lineage import stored
from veilwright.operators.lists import prefix_free_in
from veilwright.operators.matching import cols
from veilwright.operators.suppression import drop_classes
from veilwright.spec import check_columns, check_fraction
from veilwright.streaming import require_batch


#: Level vectors that are tried in one pass over the classes.
TRIED = 64


def _of_height(depth: Sequence[int], height: int) -> Iterator[tuple[int, ...]]:
    """Level vectors with the given sum, in the order of their digits."""
    if not depth:
        if height == 0:
            yield ()
        return
    for level in range(min(depth[0] - 1, height) + 1):
        for rest in _of_height(depth[1:], height - level):
            yield (level, *rest)


class _Counts:
    """Class counts of some of the columns, from which any vector of their levels can be judged."""

    def __init__(self, classes: DataFrame, columns: Sequence[int], k: int, budget: float):
        self.columns, self.k, self.budget = tuple(columns), k, budget
        labels = [f"labels_{i}" for i in self.columns]
        self.table = stored(classes.groupBy(*labels).agg(F.sum("n").alias("n")))

    def part(self, columns: Sequence[int]) -> _Counts:
        """Counts of fewer columns, rolled up from these."""
        return _Counts(self.table, columns, self.k, self.budget)

    def qualifying(self, vectors: Sequence[tuple[int, ...]]) -> set[int]:
        """Places of the vectors that qualify."""
        vector = F.posexplode(F.array(*[F.array(*map(F.lit, v)) for v in vectors])).alias("at", "vector")
        own = [F.get(f"labels_{c}", F.col("vector")[i]).alias(f"label_{c}") for i, c in enumerate(self.columns)]
        tried = self.table.select("*", vector).select("at", "n", *own)
        sizes = tried.groupBy("at", *[f"label_{c}" for c in self.columns]).agg(F.sum("n").alias("n"))
        small = F.sum(F.when(F.col("n") < self.k, F.col("n")).otherwise(0))
        judged = sizes.groupBy("at").agg(F.sum("n").alias("all"), small.alias("small"))
        fit = judged.filter(F.col("small") <= F.col("all") * F.lit(float(self.budget))).select("at").collect()
        return {r["at"] for r in fit}


def _allowed(counts: _Counts, depth: Sequence[int]) -> dict[tuple[int, ...], set[tuple[int, ...]]]:
    """For every column and every two columns the levels that qualify without the other columns.

    Leaving columns out only makes classes larger, so no vector with other levels qualifies as a whole.
    Levels of two columns are counted only if each is allowed on its own.
    """
    found: dict[tuple[int, ...], set[tuple[int, ...]]] = {}
    for size in (1, 2):
        if size == len(depth):
            break
        for columns in combinations(range(len(depth)), size):
            tried = [v for v in product(*[range(depth[c]) for c in columns]) if all((v[i],) in found[c,] for i, c in enumerate(columns) if size > 1)]
            part, fit = counts.part(columns), set()
            for start in range(0, len(tried), TRIED):
                some = tried[start : start + TRIED]
                fit |= {some[at] for at in part.qualifying(some)}
            found[columns] = fit
    return found


def full_domain(
    df: DataFrame,
    qis: Sequence[str],
    k: int,
    budget: float = 0.0,
    hierarchies: Mapping[str, tuple[Column, int]] | None = None,
) -> DataFrame:
    """Generalise every column to the lowest common level vector that makes the table k-anonymous.

    A level vector qualifies when at most ``budget`` of the rows sit in classes below ``k``;
    those rows are then removed.  The lowest is the one with the smallest sum of levels, the
    first in column order among equals.  ``hierarchies`` may give a column its own array of
    labels and the length of that array.  Levels need not nest: the levels of a widening numeric hierarchy do not.

    The table is reduced to its distinct classes once, with the labels of all levels, and these are
    written to the checkpoint folder.  Where there are many vectors, single columns and pairs of columns are looked at first, in
    counts rolled up from the classes: levels that do not qualify on their own never do together.  The vectors left over
    are tried height by height, ``TRIED`` at a time, while the plan is built, and the first that qualifies ends the
    search; a class is written out once for each vector tried.
    """
    require_batch(df, "full-domain generalisation")
    check_columns(df.columns, list(qis), "quasi-identifier")
    check_fraction(budget, "budget")
    given = hierarchies or {}
    levels = {q: given[q] if q in given else levels_of(df, q, widening=True) for q in qis}
    depth = [levels[q][1] for q in qis]
    labels = [levels[q][0].alias(f"labels_{i}") for i, q in enumerate(qis)]
    number = f"{prefix_free_in(qis)}n"
    classes = df.groupBy(*cols(qis)).agg(F.count(F.lit(1)).alias(number)).select(*labels, F.col(number).alias("n"))
    counts = _Counts(classes, range(len(qis)), k, budget)

    # where the top of all columns does not qualify, as with fewer than k rows, nothing below it does
    chosen = tuple(d - 1 for d in depth)
    if counts.qualifying([chosen]):
        # so few vectors that one pass sees them all need no pruning
        allowed = _allowed(counts, depth) if math.prod(depth) > TRIED else {}
        heights = chain.from_iterable(_of_height(depth, height) for height in range(sum(chosen) + 1))
        left = (v for v in heights if all(tuple(v[c] for c in columns) in fit for columns, fit in allowed.items()))
        while vectors := list(islice(left, TRIED)):
            fit = counts.qualifying(vectors)
            if fit:
                chosen = vectors[min(fit)]
                break
    level = dict(zip(qis, chosen, strict=True))
    rows = df.select(
        *[F.get(levels[c][0], F.lit(level[c])).alias(c) if c in level else F.col(f"`{c}`") for c in df.columns]
    )
    small = rows.groupBy(*cols(qis)).agg(F.count(F.lit(1)).alias("class_size")).filter(F.col("class_size") < k)
    return drop_classes(rows, small, qis, null_safe=True)
