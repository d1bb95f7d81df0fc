"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product.  One more component, sqrt(M^2 - |x|^2) with M the longest norm,
gives all vectors one length, and a query 0 there, so that the largest inner product is the smallest
angle.  Every tree splits by the difference of two random vectors at the median; the trees are grown on
the driver on a sample of at most ``SAMPLE_VALUES`` components, whatever the table holds, down to leaves of about
``LEAF`` sampled vectors.  Then every vector of the table is put into its leaf of every tree.

A query walks all trees through one shared priority queue ordered by the margin by which a branch was
left out, and visits the best leaves.  How many is measured: for ``CALIBRATION`` queries the true nearest
are found among all rows, and the fewest leaves are taken with which ``TARGET`` of them are found.  Queries
and vectors meet by leaf; a leaf that holds more than ``CHUNK`` vectors is cut into chunks that each query
visits.  Within a chunk candidates are ranked by exact inner products in double precision, and a query's
results of all leaves are merged.

Equal vectors are one candidate: no more of its ids than a result can hold are kept, the smallest, which
loses nothing.  Equal queries are searched once.

Rows: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components take
no part, as query or candidate, and neither do NULL ids.  An id given twice is two candidates of that id.
An empty table gives no rows.  Columns other than those named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import ship, stored

TREES, LEAF = 12, 256
#: Components of all sampled vectors together: 65,536 vectors of 64 components.
SAMPLE_VALUES = 1 << 22
CALIBRATION, TARGET = 96, 0.96
#: Vectors that meet in one chunk of a leaf.
CHUNK = 4096


@dataclass
class Tree:
    """Inner nodes as arrays: a direction, a threshold and two children; a leaf is ``~number``."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), dtype=np.int64)
        if not len(self.thresholds):
            return at
        while (inner := at >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            side = np.einsum("ij,ij->i", vectors[rows], self.directions[node]) > self.thresholds[node]
            at[rows] = self.children[node, side.astype(np.int64)]
        return ~at


def grow(sample: np.ndarray, leaf: int, draw: np.random.Generator) -> Tree:
    """Split by the difference of two random members at the median of their projections."""
    directions, thresholds, children, leaves = [], [], [], 0
    if len(sample) <= leaf:
        return Tree(np.zeros((0, sample.shape[1])), np.zeros(0), np.zeros((0, 2), dtype=np.int64), 1)
    work = [(np.arange(len(sample)), -1, 0)]
    while work:
        members, parent, side = work.pop()
        halves = None
        for _ in range(4 if len(members) > leaf else 0):
            a, b = draw.choice(members, 2, replace=False)
            direction = sample[a] - sample[b]
            projected = sample[members] @ direction
            threshold = float(np.median(projected))
            over = projected > threshold
            if 0 < over.sum() < len(members):
                halves = members[~over], members[over]
                break
        if halves is None:
            leaves += 1
            number = ~(leaves - 1)
        else:
            number = len(thresholds)
            directions.append(direction)
            thresholds.append(threshold)
            children.append([0, 0])
            work += [(halves[0], number, 0), (halves[1], number, 1)]
        if parent >= 0:
            children[parent][side] = number
    if not thresholds:
        return Tree(np.zeros((0, sample.shape[1])), np.zeros(0), np.zeros((0, 2), dtype=np.int64), 1)
    return Tree(np.array(directions), np.array(thresholds), np.array(children), leaves)


def search(trees: list[Tree], query: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The ``visits`` leaves (tree, leaf) first reached through one queue over all trees."""
    margins = [(t.directions @ query - t.thresholds).tolist() for t in trees]
    kids = [t.children for t in trees]
    queue = [(-np.inf, number, 0 if len(m) else -1) for number, m in enumerate(margins)]
    heapq.heapify(queue)
    found: list[tuple[int, int]] = []
    while queue and len(found) < visits:
        cost, number, node = heapq.heappop(queue)
        while node >= 0:
            margin = margins[number][node]
            near, far = (1, 0) if margin > 0 else (0, 1)
            heapq.heappush(queue, (max(cost, abs(margin)), number, int(kids[number][node][far])))
            node = int(kids[number][node][near])
        found.append((number, ~node))
    return found


def extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives all of them the length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _index(trees: list[Tree], longest: float, chunks: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vector id, vector) to rows (tree, leaf, chunk, kind, number, vector)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.asarray(batch.column(0))
            vectors = extended(_matrix(batch.column(1)), longest)
            for k, tree in enumerate(trees):
                leaf = tree.leaf_of(vectors)
                yield _routed(np.full(len(leaf), k), leaf, number % chunks, 0, number, batch.column(1))

    return index


def _routed(tree, leaf, chunk, kind: int, number, vectors: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(tree.astype(np.int64) << 40 | leaf << 20 | chunk, pa.int64()),
            pa.array(np.full(len(leaf), kind), pa.int32()),
            pa.array(number, pa.int64()),
            vectors,
        ],
        names=["place", "kind", "number", "vector"],
    )


def _ask(trees: list[Tree], chunks: int, visits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (query number, vector) to the leaves they visit, once for every chunk."""
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                queries = np.pad(_matrix(batch.column(1)), ((0, 0), (0, 1)))
                places = [search(trees, q, visits) for q in queries]
                row = np.repeat(np.arange(len(places)), [len(p) * chunks for p in places])
                flat = np.repeat(np.array([leaf for p in places for leaf in p]), chunks, axis=0)
                chunk = np.arange(len(row)) % chunks
                asked, vectors = np.asarray(batch.column(0))[row], batch.column(1).take(pa.array(row))
                yield _routed(flat[:, 0], flat[:, 1], chunk, 1, asked, vectors)

    return ask


def best(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``top`` largest of each row, and of all that equal the last of them."""
    if scores.shape[1] > top:
        edge = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        return np.nonzero(scores >= edge[:, None])
    return np.nonzero(np.ones(scores.shape, dtype=bool))


def _rank(top: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a place, vectors before queries: each query's nearest there, a row of two lists."""
        here, parts, vectors, own = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            code = place * 2 + kind
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in zip(edges, edges[1:], strict=False):
                part, number = batch.slice(a, b - a), np.asarray(batch.column(2))[a:b]
                if place[a] != here:
                    here, parts, vectors = int(place[a]), [], None
                if kind[a] == 0:
                    parts.append((_matrix(part.column(3)), number))
                    continue
                if vectors is None and parts:
                    vectors = np.concatenate([m for m, _ in parts])
                    own = np.concatenate([n for _, n in parts])
                if vectors is None:
                    continue
                queries = _matrix(part.column(3))
                for begin in range(0, len(queries), 512):
                    scores = queries[begin : begin + 512] @ vectors.T
                    row, column = best(scores, top)
                    ends = pa.array(np.searchsorted(row, np.arange(len(scores) + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(number[begin : begin + 512]),
                            pa.ListArray.from_arrays(ends, pa.array(own[column])),
                            pa.ListArray.from_arrays(ends, pa.array(scores[row, column])),
                        ],
                        names=["query", "numbers", "scores"],
                    )

    return rank


def _merge(top: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their query: its nearest of all places, each once."""
        held: list[pa.RecordBatch] = []

        def answer() -> pa.RecordBatch:
            group = pa.Table.from_batches(held).combine_chunks()
            numbers = np.asarray(group.column(1).combine_chunks().flatten())
            scores = np.asarray(group.column(2).combine_chunks().flatten())
            numbers, first = np.unique(numbers, return_index=True)
            scores = scores[first]
            _, column = best(scores[None, :], top)
            query = np.full(len(column), group.column(0)[0].as_py())
            return pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(numbers[column]), pa.array(scores[column])], names=["query", "number", "score"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            query = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(query)) + 1).tolist(), len(query)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != query[a]:
                    yield answer()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield answer()

    return merge


def _scan(numbers: np.ndarray, queries: np.ndarray, top: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of every batch to the few given queries, with their vectors."""
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.asarray(batch.column(0))
            scores = queries @ _matrix(batch.column(1)).T
            scores[numbers[:, None] == number[None, :]] = -np.inf
            row, column = best(scores, top)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row, pa.int32()),
                    pa.array(scores[row, column]),
                    batch.column(1).take(pa.array(column)),
                ],
                names=["query", "score", "vector"],
            )

    return scan


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no NULL or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def visits_needed(trees: list[Tree], queries: np.ndarray, nearest: list[np.ndarray], target: float) -> int:
    """The fewest leaves with which ``target`` of the ``nearest`` of all queries are found.

    ``queries`` and ``nearest`` are extended vectors.
    """
    found_after: list[int] = []
    every = sum(t.leaves for t in trees)
    for query, near in zip(queries, nearest, strict=True):
        if not len(near):
            continue
        turn = {leaf: i + 1 for i, leaf in enumerate(search(trees, query, every))}
        at = np.array([[turn[k, leaf] for leaf in t.leaf_of(near).tolist()] for k, t in enumerate(trees)])
        found_after += at.min(axis=0).tolist()
    if not found_after:
        return every
    found_after.sort()
    return found_after[max(int(np.ceil(target * len(found_after))) - 1, 0)]


def _rows(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of a table small enough for the driver."""
    found = df.toArrow().combine_chunks()
    if not found.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    return np.asarray(found.column(0)), _matrix(found.column(1).combine_chunks())


def nearest(df: DataFrame, query: Column, top: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``top`` nearest of every row for which ``query`` holds: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("vector"), F.coalesce(query, F.lit(False)).alias("asks")
    ).filter(F.col("id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    dimension = sizes[0]["size"] if sizes else 1
    rows = rows.filter(F.size("vector") == dimension)
    # of equal vectors the smallest ids, one more than a result holds: a query leaves out its own
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= top + 1)
    classes = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stored(classes.withColumn("number", F.monotonically_increasing_id()))
    askers = rows.filter("asks").select("id", "vector")
    same = (F.xxhash64("vector") == F.xxhash64("own")) & (F.col("vector") == F.col("own"))
    known = classes.select("number", F.col("vector").alias("own"))
    askers = stored(askers.join(known, same).select("id", "number", "vector"))
    questions = stored(askers.select("number", "vector").distinct())

    count = classes.count()
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    longest = classes.agg(F.max(norm).alias("longest")).collect()[0]["longest"] or 0.0
    sample_rows = max(SAMPLE_VALUES // dimension, 2 * LEAF)
    share = F.pmod(F.xxhash64("number", F.lit("sample")), F.lit(1 << 20)) < min(1.0, sample_rows / max(count, 1)) * (1 << 20)
    _, sample = _rows(classes.filter(share).select("number", "vector").limit(sample_rows))
    sample = extended(sample.reshape(len(sample), dimension), longest)
    draw = np.random.default_rng(5)
    trees = [grow(sample, LEAF, draw) for _ in range(TREES)]
    chunks = max(1, -(-count // (min(t.leaves for t in trees) * CHUNK)))

    chosen = questions.orderBy(F.xxhash64("number")).limit(CALIBRATION)
    numbers, probes = _rows(chosen.select("number", "vector"))
    near: list[np.ndarray] = []
    if len(numbers):
        first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        scan = classes.select("number", "vector").mapInArrow(
            _scan(numbers, probes, top), f"query int, score double, vector {classes.schema['vector'].dataType.simpleString()}"
        )
        true = scan.filter(F.col("score") > F.lit(float("-inf"))).withColumn("rank", first).filter(F.col("rank") <= top)
        of, vectors = _rows(true.select("query", "vector"))
        near = [extended(vectors[of == i].reshape(-1, dimension), longest) for i in range(len(numbers))]
    visits = visits_needed(trees, np.pad(probes, ((0, 0), (0, 1))), near, TARGET)

    kind = classes.schema["vector"].dataType.simpleString()
    routed = f"place bigint, kind int, number bigint, vector {kind}"
    index = classes.select("number", "vector").mapInArrow(_index(trees, longest, chunks), routed)
    asked = questions.select("number", "vector").mapInArrow(_ask(trees, chunks, visits), routed)
    met = index.unionByName(asked).repartition("place").sortWithinPartitions("place", "kind")
    answers = met.mapInArrow(_rank(top + 1), "query bigint, numbers array<bigint>, scores array<double>")
    merged = answers.repartition("query").sortWithinPartitions("query").mapInArrow(
        _merge(top + 1), "query bigint, number bigint, score double"
    )
    candidates = merged.join(classes.select("number", "ids"), "number").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = askers.select(F.col("id").alias("query_id"), F.col("number").alias("query")).join(candidates, "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
