"""Packing documents into sequences by the sum-of-squares rule.

A document longer than a sequence is cut into whole sequences and one shorter first piece; the rest
are items.  Items meet in groups of bounded size, longest first.  With N(g) open sequences that have
g free places, an item goes where the sum of N(g)^2 over all gaps becomes smallest, a new sequence
included; ties go to the smallest gap.  What remains poorly filled after that is packed again, whole
contents as items, in far fewer groups, so that groups cost next to nothing.

Rows: NULL and empty texts are the end id alone.  NULL, repeated and equal ids are items like any
other.  An empty table makes no piece.  Columns other than those named are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import ship, stored
from veilwright.llm.tokens import documents

END_ID = 0
#: Items that meet in one group; a group of them takes a few seconds and some MB.
GROUP_ITEMS = 50_000
#: A sequence that is filled to a smaller share is packed again in the second round.
FULL = 0.98
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every item, by the sum-of-squares rule, longest item first."""
    sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    open_gaps = np.zeros(capacity + 1, dtype=np.int64)  # N(g); N(0) stays 0
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        # (N(g) - 1)^2 - N(g)^2 + (N(g - size) + 1)^2 - N(g - size)^2; an exact fit makes no new gap
        change = 2 * (open_gaps[: capacity + 1 - size] - open_gaps[size:]) + 2
        change[0] = 1 - 2 * open_gaps[size]
        change[open_gaps[size:] == 0] = 4 * len(sizes)
        change[-1] = 2 * open_gaps[capacity - size] + 1  # a new sequence adds a gap and takes none
        gap = int(np.argmin(change)) + size
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = bins[gap].pop()
            open_gaps[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            bins[gap - size].append(at)
            open_gaps[gap - size] += 1
    return sequence, offset


def _cutter(vocabulary: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(
                batch.column(0).to_pylist(), documents(vocabulary, batch.column(1), END_ID), strict=True
            ):
                head = len(ids) % capacity or capacity
                edges = [0, *range(head, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    values = (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                    for column, value in zip(rows.values(), values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(rows))

    return cut


def pieces(df: DataFrame, vocabulary: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text, end id included, cut to ``capacity``; a first piece may be shorter."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_cutter(vocabulary, capacity), PIECE)


def _packer(size: str, capacity: int, number: str, at: str):
    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.copy()
        group[number], group[at] = place(group[size].to_numpy(), capacity)
        return group

    return pack_group


def _placed(items: DataFrame, count: int, size: str, capacity: int, number: str, at: str) -> DataFrame:
    """Items with their ``group``, sequence ``number`` in it and offset ``at``."""
    groups = max(1, math.ceil(count / GROUP_ITEMS))
    keyed = items.withColumn("group", F.pmod(F.xxhash64(F.lit(number), "item"), F.lit(groups)).cast("bigint"))
    schema = f"{keyed.select(*items.columns).schema.simpleString()[7:-1].replace(':', ' ')}"
    return keyed.groupBy("group").applyInPandas(
        _packer(size, capacity, number, at), f"{schema}, group bigint, {number} bigint, {at} bigint"
    )


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``: gapless within a sequence of at most ``capacity`` ids."""
    # the number is written with the piece, so it tells equal pieces apart for good
    items = stored(pieces(df, vocabulary, capacity, key, text).withColumn("item", F.monotonically_increasing_id()))
    whole = items.filter(F.col("length") == capacity)
    parts = items.filter(F.col("length") < capacity).select("item", "length")
    first = stored(_placed(parts, parts.count(), "length", capacity, "number", "at"))
    filled = first.groupBy("group", "number").agg(F.sum("length").alias("fill"))
    loose = filled.filter(F.col("fill") < FULL * capacity).withColumn("item", F.struct("group", "number"))
    loose = stored(loose.select("item", "fill"))
    again = stored(_placed(loose, loose.count(), "fill", capacity, "second", "shift"))
    moved = again.select(
        F.col("item.group").alias("group"),
        F.col("item.number").alias("number"),
        F.struct(F.lit(2).alias("round"), F.col("group"), F.col("second").alias("number")).alias("place"),
        "shift",
    )
    placed = first.join(moved, ["group", "number"], "left").select(
        "item",
        F.coalesce("place", F.struct(F.lit(1).alias("round"), "group", "number")).alias("place"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    located = items.select("item", "doc_id", "piece", "start", "length", "ids_crc32").join(placed, "item")
    zero = F.lit(0).cast("bigint")
    own = F.struct(F.lit(0).alias("round"), zero.alias("group"), F.col("item").alias("number"))
    alone = whole.select("*", own.alias("place"), zero.alias("offset"))
    # the three kinds of place take turns; a group never has more sequences than a 32-bit number counts
    grouped = F.col("place.group") * F.lit(1 << 32) + F.col("place.number")
    code = F.when(F.col("place.round") == 0, F.col("place.number")).otherwise(grouped)
    return located.unionByName(alone).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (code * 3 + F.col("place.round")).alias("sequence_id"),
        F.col("offset"),
    )
