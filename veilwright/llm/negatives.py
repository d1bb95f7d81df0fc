"""Hard negatives by exact scores, where angles to reference directions say what need not be scored.

A component x becomes floor(scale * x), and a score is the inner product of two such vectors, a whole number.
Each vector stores its norm and its angles to ``REFERENCES`` directions.  By the triangle inequality the angle
between two vectors is at least the difference of their angles to a direction and at most their sum, and at most
what is left of a full turn.  The cosines of those limits times the norms, rounded outwards, bound the score.

Vectors lie in cells, in the order of label, nearest direction and angle to it, and within a cell in runs of
``RUN`` vectors, for each of which the window of every stored angle is known.  An anchor scores a run only where
its bounds overlap a window of scores that the anchor still asks for.  First that is every score as high as the best
``positives`` so far, over rows of its own label; then, for each positive, the scores from ``low`` to ``high`` percent of
the positive's that are as high as the best ``negatives`` so far, over rows of other labels.  Nothing is estimated: what
is not scored cannot be in the result.  Where vectors are nearly random, as in many dimensions, the bounds are
wide and nearly all runs are scored.

Anchors and cells meet in blocks: anchors in groups of at most about ``GROUP`` rows, which a task holds, while the
vectors of a cell stream past.  Vectors are written once per group and anchors once per cell, in such numbers that
both sides cost the same.  A label or a vector that makes up a third of the rows is spread over cells like any other.

Rows with a NULL label, or a vector that is NULL, holds NULL or non-finite components or is of another length than most,
take no part.  A zero vector scores 0 with everything.  Ties go by the smaller id; a NULL id comes after all others (an id
of 2^63 - 1 is read as NULL) and is an anchor where ``anchor`` says so.  Repeated rows are rows of their own: each is an
anchor and another's positive.  An empty table gives no rows.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import ship, stored

REFERENCES, RUN, GROUP, CELL = 8, 256, 16_384, 4096
#: Vectors that pass a group of anchors at a time.
CHUNK = 16 * RUN
#: Angles are stored in single precision; each limit is moved outwards by more than that costs.
SLACK = 1e-6
#: Share of the product of the norms by which a bound is moved outwards before it is rounded.
MARGIN = 1e-9
LAST = (1 << 63) - 1
LEAST = -LAST
INDEXED = "number bigint, id bigint, label bigint, asks boolean, whole array<bigint>, norm double, angles array<float>, pivot int"


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _index(references: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Norm, angles and nearest direction of each vector."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("whole"), references.shape[1]).astype(np.float64)
            norm = np.sqrt((vectors * vectors).sum(axis=1))
            cosine = vectors @ references.T / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            more = [pa.array(norm), lists(angles, pa.float32()), pa.array(angles.argmin(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "norm", "angles", "pivot"])

    return index


def score_bounds(
    norm: np.ndarray, angles: np.ndarray, norms: tuple[np.ndarray, np.ndarray], windows: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score (anchor, run) from the anchor's angles and the runs' windows of norms and angles."""
    own = angles[:, None, :]
    (shortest, longest), (start, end) = norms, windows
    least = np.maximum(start[None] - own, own - end[None]).max(axis=2)
    most = np.minimum(own + end[None], 2 * np.pi - own - start[None]).min(axis=2)
    high = np.cos(np.clip(least - SLACK, 0, np.pi))
    low = np.cos(np.clip(most + SLACK, 0, np.pi))
    product = norm[:, None]
    margin = MARGIN * product * longest[None] + MARGIN
    upper = product * np.where(high > 0, longest[None], shortest[None]) * high + margin
    lower = product * np.where(low > 0, shortest[None], longest[None]) * low - margin
    return np.ceil(lower), np.floor(upper)


def first_of_groups(group: np.ndarray, score: np.ndarray, number: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores of each group, ties by the smaller number, in order."""
    order = np.lexsort((number, -score, group))
    turn = np.arange(len(order))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order[turn - np.repeat(starts, np.diff(np.append(starts, len(order)))) < top]


class Meeting:
    """A group of anchors, and the best scores of the vectors that have passed by."""

    def __init__(self, dimension: int, top: int, same_label: bool):
        self.dimension, self.top, self.same_label = dimension, top, same_label
        self.parts: list[pa.RecordBatch] = []
        self.ready = False

    def _prepare(self) -> None:
        held = pa.Table.from_batches(self.parts).combine_chunks()
        column = {n: held.column(n).combine_chunks() for n in held.column_names} if held.num_rows else {}
        self.parts, self.ready = [], True
        self.number = np.asarray(column["number"])
        self.label = np.asarray(column["label"])
        self.whole = matrix(column["whole"], self.dimension)
        self.norm = np.asarray(column["norm"])
        self.angles = np.asarray(column["angles"].flatten(), dtype=np.float64).reshape(len(self.number), -1)
        counts = np.asarray(column["low"].value_lengths())
        width = int(counts.max())
        # windows that an anchor lacks are empty
        self.low = np.full((len(counts), width), LAST)
        self.high = np.full((len(counts), width), LEAST)
        there = np.arange(width)[None, :] < counts[:, None]
        self.low[there] = np.asarray(column["low"].flatten())
        self.high[there] = np.asarray(column["high"].flatten())
        self.floor = self.low.copy()
        empty = (*self.low.shape, self.top)
        self.best, self.of = np.full(empty, LEAST), np.full(empty, LAST)

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Put scores (anchor, vector) of some anchors among the best of their windows."""
        for window in range(self.low.shape[1]):
            fits = allowed & (scores >= self.floor[rows, window][:, None]) & (scores <= self.high[rows, window][:, None])
            at, which = np.nonzero(fits)
            if not len(at):
                continue
            touched = np.unique(at)
            mine = rows[touched]
            group = np.concatenate([np.repeat(touched, self.top), at])
            score = np.concatenate([self.best[mine, window].reshape(-1), scores[at, which].astype(np.int64)])
            number = np.concatenate([self.of[mine, window].reshape(-1), ids[which]])
            # empty places count as scores below all others, so every group has ``top`` of them at least
            first = first_of_groups(group, score, number, self.top)
            self.best[mine, window] = score[first].reshape(-1, self.top)
            self.of[mine, window] = number[first].reshape(-1, self.top)
            self.floor[mine, window] = np.maximum(self.low[mine, window], self.best[mine, window, -1])

    def pass_by(self, batch: pa.RecordBatch) -> None:
        if not self.ready:
            self._prepare()
        number, ids, label = (np.asarray(batch.column(n)) for n in ("number", "id", "label"))
        vectors, norm = matrix(batch.column("whole"), self.dimension), np.asarray(batch.column("norm"))
        angles = np.asarray(batch.column("angles").flatten(), dtype=np.float64).reshape(len(number), -1)
        starts = np.arange(0, len(number), RUN)
        windows = np.minimum.reduceat(angles, starts), np.maximum.reduceat(angles, starts)
        norms = np.minimum.reduceat(norm, starts), np.maximum.reduceat(norm, starts)
        labels = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        lower, upper = score_bounds(self.norm, self.angles, norms, windows)
        largest = int(np.abs(self.whole).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * self.dimension
        kind = np.float64 if largest < 1 << 53 else object
        for run, start in enumerate(starts):
            part = slice(start, start + RUN)
            if self.same_label:
                met = (self.label >= labels[0][run]) & (self.label <= labels[1][run])
            else:
                met = (self.label != labels[0][run]) | (self.label != labels[1][run])
            # what an anchor asks for rises as vectors pass, so it is looked at anew for every run
            overlap = (lower[:, run, None] <= self.high) & (upper[:, run, None] >= self.floor) & (self.floor <= self.high)
            rows = np.flatnonzero(met & overlap.any(axis=1))
            if not len(rows):
                continue
            scores = self.whole[rows].astype(kind) @ vectors[part].astype(kind).T
            alike = self.label[rows][:, None] == label[part][None]
            allowed = alike & (self.number[rows][:, None] != number[part][None]) if self.same_label else ~alike
            self._keep(rows, scores, ids[part], allowed)

    def found(self) -> pa.RecordBatch | None:
        if not self.ready:
            return None
        # an anchor's empty places hold the smallest whole number, which no score reaches
        row, window, place = np.nonzero(self.best > LEAST)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.number[row]),
                pa.array(window, pa.int32()),
                pa.array(self.best[row, window, place]),
                pa.array(self.of[row, window, place]),
            ],
            names=["anchor", "window", "score", "id"],
        )


def _meet(dimension: int, top: int, same_label: bool):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of place, anchors before vectors: the best of each anchor in each place."""
        here, meeting = None, None
        for batch in batches:
            place = np.asarray(batch.column("place"))
            asks = np.asarray(batch.column("asks"))
            change = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows] if batch.num_rows else []
            for start, end in zip(edges, edges[1:], strict=False):
                if place[start] != here:
                    if meeting is not None and (out := meeting.found()) is not None:
                        yield out
                    here, meeting = place[start], Meeting(dimension, top, same_label)
                part = batch.slice(start, end - start)
                if asks[start]:
                    meeting.parts.append(part)
                elif meeting.parts or meeting.ready:
                    for at in range(0, part.num_rows, CHUNK):
                        meeting.pass_by(part.slice(at, CHUNK))
        if meeting is not None and (out := meeting.found()) is not None:
            yield out

    return meet


def _best(anchors: DataFrame, index: DataFrame, groups: int, dimension: int, top: int, same_label: bool) -> DataFrame:
    """(anchor, window, rank, score, id): the ``top`` scores in each window of each anchor.

    ``anchors`` has a column ``cell``, the cell to look into, and the limits ``low`` and ``high`` of the windows.
    """
    group = F.pmod(F.xxhash64("number", F.lit("group")), F.lit(groups))
    columns = ["number", "id", "label", "whole", "norm", "angles"]
    asking = anchors.select((F.col("cell") * groups + group).alias("place"), F.lit(True).alias("asks"), *columns, "low", "high", "pivot")
    none = F.lit(None).cast("array<bigint>")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
    passing = index.withColumn("group", every).select(
        (F.col("cell") * groups + F.col("group")).alias("place"),
        F.lit(False).alias("asks"), *columns, none.alias("low"), none.alias("high"), "pivot",
    )
    met = (
        asking.unionByName(passing)
        .repartition("place")
        .sortWithinPartitions("place", F.desc("asks"), "label", "pivot", F.get("angles", "pivot"), "id")
    )
    answers = met.mapInArrow(_meet(dimension, top, same_label), "anchor bigint, window int, score bigint, id bigint")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def usable(vector: Column) -> Column:
    """No NULL, no NULL component and no non-finite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def percent(score: str, share: int) -> tuple[Column, Column]:
    """``share`` percent of a whole number, rounded up and rounded down, without leaving whole numbers."""
    base = F.expr(f"(`{score}` - pmod(`{score}`, 100)) div 100 * {share}")
    rest = F.pmod(score, F.lit(100)) * share
    return base + F.ceil(rest / 100), base + F.floor(rest / 100)


def mine(
    df: DataFrame,
    anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The negatives of every row for which ``anchor`` holds: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = df.sparkSession
    ship(spark)
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = df.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST)).alias("id"),
        label.cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
        F.col(f"`{vector}`").alias("vector"),
    ).filter(F.col("label").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not sizes or not sizes[0]["size"]:
        return spark.createDataFrame([], out)
    dimension = sizes[0]["size"]
    ints = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = rows.filter(F.size("vector") == dimension).select("id", "label", "asks", ints.alias("whole"))
    chosen = rows.filter(F.exists("whole", lambda x: x != 0)).orderBy(F.xxhash64("whole"), "whole").limit(REFERENCES)
    references = np.array([r["whole"] for r in chosen.select("whole").collect()], dtype=np.float64).reshape(-1, dimension)
    if not len(references):
        references = np.eye(1, dimension)
    references /= np.sqrt((references * references).sum(axis=1))[:, None]
    numbered = stored(rows.withColumn("number", F.monotonically_increasing_id()).select("number", "id", "label", "asks", "whole"))
    count = numbered.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("anchors")).collect()[0]
    if not count["anchors"]:
        return spark.createDataFrame([], out)
    groups = -(-count["anchors"] // GROUP)
    cells = max(1, min(-(-count["rows"] // CELL), -(-groups * count["rows"] // count["anchors"])))
    index = numbered.mapInArrow(_index(references), INDEXED)
    index = index.repartitionByRange(cells, "label", "pivot", F.get("angles", "pivot"), "number")
    index = stored(index.withColumn("cell", F.spark_partition_id().cast("bigint")))

    asking = index.filter("asks").drop("cell")
    lowest, highest = F.array(F.lit(LEAST)), F.array(F.lit(LAST))
    cells_of = index.select(F.col("label").alias("of_label"), "cell").distinct()
    own = asking.join(cells_of, F.col("label") == F.col("of_label")).drop("of_label")
    near = _best(own.withColumns({"low": lowest, "high": highest}), index, groups, dimension, positives, True)
    near = near.select(
        "anchor",
        (F.col("rank") - 1).alias("window"),
        F.col("id").alias("positive"),
        F.col("score").alias("positive_score"),
        percent("score", low)[0].alias("low"),
        percent("score", high)[1].alias("high"),
    )
    near = stored(near)
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("windows"))
    windows = windows.select(F.col("anchor").alias("number"), F.col("windows.low").alias("low"), F.col("windows.high").alias("high"))
    last = index.agg(F.max("cell")).collect()[0][0]
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))
    far = asking.join(windows, "number").withColumn("cell", every)
    found = _best(far, index, groups, dimension, negatives, False)
    names = asking.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"))
    paired = found.withColumnsRenamed({"id": "negative", "score": "negative_score"}).join(near, ["anchor", "window"]).join(names, "anchor")
    return paired.select(
        F.nullif("anchor_id", F.lit(LAST)).alias("anchor_id"),
        F.nullif("positive", F.lit(LAST)).alias("positive_id"),
        "rank",
        F.nullif("negative", F.lit(LAST)).alias("negative_id"),
        "positive_score",
        "negative_score",
    )
