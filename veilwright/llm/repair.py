"""Token files compressed by Re-Pair grammars.

Documents are written in ascending order of their id, in shards of about a million ids.  Within a
shard the most frequent pairs of neighbouring ids are replaced by new symbols, again and again,
until no pair is frequent or all symbols are taken.  A shard keeps its rules, the expansion length of every rule, and per
document the number of ids and of symbols, so that any document is decoded by expanding its own
symbols alone.  Symbols fit in 16 bits.  The end id never enters a rule: no symbol spans two
documents.

The file format is Parquet, one row per shard, with the columns of ``SCHEMA``.  Spark writes, commits
and, when an executor is lost, writes again.

Rows: a NULL or empty text is the end id alone.  NULL ids come first; rows with one id are ordered by
a hash of the text.  A text longer than a shard makes a shard of its own.  An empty table makes no
shard.  Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm.common import before, ship
from veilwright.llm.tokens import documents, gather

SHARD_IDS = 1 << 20
#: Symbols fit in 16 bits; a pair is frequent from so many occurrences in a shard on.
SYMBOLS = 1 << 16
FREQUENT = 8
#: Eight times the frequency that the first pass asks for.
FIRST_OFTEN = 1 << 12
END_ID = 0
#: Slots by which pairs are found, a multiplier and a shift that deal 32 bits out over them.
SLOTS, MIX, SHIFT = 1 << 18, np.uint32(0x9E3779B1), np.uint32(14)
SCHEMA = (
    "part int, shard int, doc_ids array<bigint>, n_ids array<bigint>, n_symbols array<bigint>, "
    "base int, rules binary, expansion binary, symbols binary, total bigint"
)


def _winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at the places ``at`` (rising) are replaced: no two of them overlap.

    Of pairs that overlap the one of higher rank, where it is higher than both its neighbours; of a pair that
    overlaps itself, as in a run of one id, every second.  The highest rank of all wins wherever it does not overlap itself.
    """
    touches = np.diff(at) == 1
    higher, equal = rank[1:] > rank[:-1], rank[1:] == rank[:-1]
    beats_next, beats_last = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    beats_next[:-1] = ~touches | ~higher
    beats_last[1:] = ~touches | higher | equal
    wins = beats_next & beats_last
    # within a run of overlaps the first stands before ``repeated``
    repeated = np.flatnonzero(touches & equal) + 1
    begins = np.diff(repeated, prepend=-1) != 1
    place = np.arange(len(repeated))
    wins[repeated[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]] = False
    won = np.flatnonzero(wins)
    # the end of a run may still touch what stands before it
    return won[np.append(True, np.diff(at[won]) > 1)] if len(won) else won


def _among(pairs: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys that are among the pairs (rising, no two equal), and their numbers there.

    Looked up by slot; only where several pairs have one slot the number is searched for.
    """
    slots, numbers = (pairs * MIX) >> SHIFT, np.arange(len(pairs), dtype=np.int32)
    table = np.full(SLOTS, -1, dtype=np.int32)
    table[slots] = numbers
    several = slots[table[slots] != numbers]
    table[several] = len(pairs)
    which = table[(key * MIX) >> SHIFT]
    at = np.flatnonzero(which >= 0)
    which, key = which[at], key[at]
    unsure = np.flatnonzero(which == len(pairs))
    which[unsure] = np.minimum(np.searchsorted(pairs, key[unsure]), len(pairs) - 1)
    same = np.flatnonzero(pairs[which] == key)
    return at[same], which[same]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, rising, and how often each occurs: sorting is faster than counting one by one."""
    in_order = np.sort(values)
    edge = np.flatnonzero(in_order[1:] != in_order[:-1]) + 1
    edge = np.concatenate(([0], edge)) if len(values) else edge
    return in_order[edge], np.diff(edge, append=len(values))


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``rules`` (pairs of symbols; rule i makes symbol ``base + i``) and the ``symbols`` that are left.

    Each pass counts all pairs and replaces those of at least a certain frequency, an eighth of the one before,
    down to ``FREQUENT``; a rule is made of a pair that is replaced twice or more.  Once all pairs of that frequency are
    known, only those that were not replaced and those with a new symbol can have it: later passes look at their places alone.
    """
    x = ids.astype(np.uint16)
    rules: list[np.ndarray] = []
    n_rules = 0
    often = FIRST_OFTEN
    live = None
    while len(x) > 1 and base + n_rules < SYMBOLS:
        often = max(often // 8, FREQUENT)
        if live is None:
            # a pair is no more frequent than its rarer half
            ids_there, count = _counted(x)
            common = np.zeros(SYMBOLS, dtype=bool)
            common[ids_there[count >= often]] = True
            common[END_ID] = False
            inside = common.take(x)
            looked_at = inside[:-1] & inside[1:]
            at = np.flatnonzero(looked_at)
            key = ((x[:-1].astype(np.uint32) << 16) | x[1:])[looked_at]
        else:
            at = live[(x[live] != END_ID) & (x[1:][live] != END_ID)]
            key = (x[at].astype(np.uint32) << 16) | x[1:][at]
        pairs, weight = _counted(key)
        frequent = weight >= often
        pairs, weight = pairs[frequent], weight[frequent]
        if not len(pairs):
            if often == FREQUENT:
                break
            continue
        hit, which = _among(pairs, key)
        at = at[hit]
        stays = np.zeros(len(x), dtype=bool)
        stays[at] = True
        room = SYMBOLS - base - n_rules
        if len(pairs) > room:
            # pairs that find no symbol left stay and may find one in the next pass
            most = np.sort(np.argsort(-weight, kind="stable")[:room])
            number = np.full(len(pairs), -1, dtype=np.int32)
            number[most] = np.arange(room, dtype=np.int32)
            which = number[which]
            at, which = at[which >= 0], which[which >= 0]
            pairs, weight = pairs[most], weight[most]
        won = _winners(at, (weight * len(pairs) + np.arange(len(pairs)))[which])
        at, which = at[won], which[won]
        used = np.bincount(which, minlength=len(pairs)) > 1
        won = used[which]
        at, which = at[won], which[won]
        x[at] = (base + n_rules - 1 + np.cumsum(used))[which]
        stays[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(x), dtype=bool)
        keep[at + 1] = False
        x = x[keep]
        live = np.flatnonzero(stays[keep][:-1]) if often == FREQUENT else None
        rules.append(np.stack([pairs[used] >> 16, pairs[used] & 0xFFFF], axis=1).astype("<u2"))
        n_rules += int(used.sum())
    return (np.concatenate(rules) if rules else np.zeros((0, 2), dtype="<u2")), x.astype("<u2")


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    found = [1] * base
    for a, b in rules.tolist():
        found.append(found[a] + found[b])
    return np.array(found, dtype=np.int64)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols expanded, one after another, and the length of each expansion."""
    own = np.arange(base, dtype="<u2").tobytes()
    parts: list[bytes] = []
    for pair in rules.tolist():
        parts.append(b"".join([own[2 * s : 2 * s + 2] if s < base else parts[s - base] for s in pair]))
    lengths = np.ones(base + len(parts), dtype=np.int64)
    lengths[base:] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
    return np.frombuffer(own + b"".join(parts), dtype="<u2"), lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols``, any part of a shard, stand for."""
    flat, lengths = expansions(rules, base)
    return gather(flat, (np.cumsum(lengths) - lengths)[symbols], lengths[symbols])


def _shard(part: int, number: int, doc_ids: list, docs: list[np.ndarray], base: int) -> dict:
    counts = np.array([len(d) for d in docs])
    rules, symbols = compress(np.concatenate(docs), base)
    lengths = lengths_of(rules, base)
    ends = np.searchsorted(np.cumsum(lengths[symbols]), np.cumsum(counts)) + 1
    return {
        "part": part,
        "shard": number,
        "doc_ids": doc_ids,
        "n_ids": counts.tolist(),
        "n_symbols": np.diff(ends, prepend=0).tolist(),
        "base": base,
        "rules": rules.tobytes(),
        "expansion": lengths[base:].astype("<u4").tobytes(),
        "symbols": symbols.tobytes(),
        "total": int(counts.sum()),
    }


def _writer(vocabulary: str, base: int, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, docs, held, number = [], [], 0, 0
        for batch in batches:
            for doc_id, ids in zip(
                batch.column(0).to_pylist(), documents(vocabulary, batch.column(1), END_ID), strict=True
            ):
                if docs and held + len(ids) > SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([_shard(part, number, doc_ids, docs, base)], schema)
                    doc_ids, docs, held, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                docs.append(ids)
                held += len(ids)
        if docs:
            yield pa.RecordBatch.from_pylist([_shard(part, number, doc_ids, docs, base)], schema)

    return write


def write(df: DataFrame, path: str, vocabulary: str, base: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents to ``path`` in ascending order of ``key``.

    ``base`` is the number of ids in the vocabulary; parts and shards are numbered in the order of
    the documents.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    tie = F.xxhash64("text")
    # with the tie in the range, texts of one id, or of none, are spread over tasks
    ordered = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    ordered.mapInArrow(_writer(vocabulary, base, arrow), SCHEMA).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            rules = np.frombuffer(row["rules"].as_buffer(), dtype="<u2").reshape(-1, 2)
            ids = expand(np.frombuffer(row["symbols"].as_buffer(), dtype="<u2"), rules, row["base"].as_py()).astype("<u4")
            counts = np.asarray(row["n_ids"].values)
            ends = np.cumsum(counts)
            starts, n = ends - counts, len(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.repeat(row["part"], n),
                    "shard": pa.repeat(row["shard"], n),
                    "doc_id": row["doc_ids"].values,
                    "at": pa.array(starts, pa.int64()),
                    "ids": pa.ListArray.from_arrays(
                        pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.view("<i4"), pa.int32())
                    ),
                }
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files at ``path``: part, shard, doc_id, place ``at`` in the shard, ``ids``."""
    ship(spark)
    return spark.read.parquet(path).mapInArrow(
        _decode, "part int, shard int, doc_id bigint, at bigint, ids array<int>"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decode(batches):
        lists = batch.column("ids")
        flat, offsets = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        arrays = [*batch.columns[:4], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: ``start`` (ids of all documents before it), number and CRC32 of its ids.

    Shards are summed by part first; a window over all parts has one row for each of them.
    """
    ship(spark)
    totals = spark.read.parquet(path).select("part", "shard", "total")
    within = totals.withColumn("inside", before(F.col("total"), Window.partitionBy("part").orderBy("shard")))
    parts = totals.groupBy("part").agg(F.sum("total").alias("sum"))
    parts = parts.select("part", before(F.col("sum"), Window.orderBy("part")).alias("outside"))
    starts = within.join(parts, "part").select("part", "shard", (F.col("inside") + F.col("outside")).alias("base"))
    digests = spark.read.parquet(path).mapInArrow(
        _digest, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return digests.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).cast("bigint").alias("start"), "n_tokens", "ids_crc32"
    )
