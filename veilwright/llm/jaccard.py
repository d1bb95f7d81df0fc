"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles.  Documents with equal sets are one text and are collapsed
first.  The sets are then split recursively, ``RUNS`` times over: every set goes down to the bucket of a
sampled token of its own, the one with the smallest value of that level's hash function, so two sets
share the path to a bucket at each level with the probability of their Jaccard similarity.  Buckets of
at most ``BUCKET`` sets are not split any further.  Within a bucket sets are compared by their sampled
tokens, and sets that agree in at least ``LOOSE`` of them are linked to each other.

Connected components of these loose links are then compared exactly, every pair of sets within a
component, in blocks of bounded size, so a component of any size spreads over many tasks, every link
is counted once, and no pair is written out: a block pair returns the number of links of each set and
a spanning forest.  Links of the forests give the classes.

With ``RUNS`` runs and d levels a pair of similarity 0.8 is missed with probability (1 - 0.8^d)^RUNS:
for two levels 4 in 100,000, for three 8 in 10,000.

Rows: NULL and empty texts, and texts of fewer words than a shingle, have the one shingle of all their
words; a text without words has none and is linked to nothing but its equals.  NULL ids and repeated rows
are documents of their own; a class is named by its smallest id.  An empty table stays empty.  Columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import fresh, ship, stored
from veilwright.llm.components import components

#: Words of a shingle, and the similarity from which two texts are linked.
WORDS, SIMILARITY = 5, 0.8
RUNS, LEVELS = 10, 3
#: A bucket of so many sets is compared as it is; after the last level larger ones are, in blocks.
BUCKET = 256
#: Share of sampled tokens in which loosely linked sets agree; the true share is at least 0.8.
LOOSE = 0.5
#: Sets that meet in one block of a bucket that stays large, and shingles that meet in one block of the exact comparison.
BLOCK_SETS = 2048
BLOCK_SHINGLES = 1 << 20
#: The side of the rows of a block that meets itself; of two blocks they are 0 and 1.
ALONE = -1
WORD = re.compile(r"\w+")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``; case and punctuation do not count."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(words, len(codes))
    total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for place in range(width):
        total = (total ^ codes[place : place + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def sampled(shingle_set: np.ndarray) -> np.ndarray:
    """For each of ``RUNS * LEVELS`` hash functions its smallest value over a set that is not empty."""
    low, high = shingle_set.astype(np.uint32), (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.empty(RUNS * LEVELS, dtype=np.uint32)
    for i, factor in enumerate(np.random.default_rng(41).integers(1, 1 << 32, len(out), dtype=np.uint64).tolist()):
        mixed = low * np.uint32(factor | 1) + high
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(13)
        out[i] = mixed.min()
    return out


SETS = "doc_id bigint, text_hash bigint, set_high bigint, set_low bigint, size bigint, tokens array<int>"


def _signed(values: list[int], bits: int) -> np.ndarray:
    return np.array(values, dtype=f"<u{bits // 8}").view(f"<i{bits // 8}")


def _describe(words: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, tokens, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                found = shingles(text, words)
                # without words there is nothing to compare: only equal texts are the same
                digests.append(xxhash.xxh3_128_intdigest(found.tobytes() if len(found) else (text or "").encode()))
                sizes.append(len(found))
                if len(found):
                    tokens.append(sampled(found))
                ends.append(ends[-1] + (RUNS * LEVELS if len(found) else 0))
            flat = np.concatenate(tokens).view(np.int32) if tokens else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(_signed([d >> 64 for d in digests], 64)),
                    pa.array(_signed([d & (1 << 64) - 1 for d in digests], 64)),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=[part.split()[0] for part in SETS.split(", ")],
            )

    return describe


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal first column, which may reach over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, one after another, and where each list begins and ends."""
    lists = column.combine_chunks()
    offsets = np.asarray(lists.offsets)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Forest:
    """Labels of linked places: the smallest place of each tree."""

    def __init__(self, count: int):
        self.label = np.arange(count)

    def link(self, place: int, others: np.ndarray) -> None:
        labels = np.unique(self.label[others])
        labels = np.unique(np.append(labels, self.label[place]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, side, rep, tokens): links of each set to the smallest of its tree in the group."""
    need = LOOSE * RUNS * LEVELS
    for group in groups(batches):
        side, rep = np.asarray(group.column(1)), np.asarray(group.column(2))
        tokens = np.asarray(_lists(group.column(3))[0]).reshape(len(rep), -1)
        forest = Forest(len(rep))
        first = np.flatnonzero(side < 1)
        second = np.flatnonzero(side == 1)
        for place in first.tolist():
            others = np.arange(place + 1, len(rep)) if side[0] == ALONE else second
            if len(others):
                others = others[forest.label[others] != forest.label[place]]
                same = (tokens[others] == tokens[place]).sum(axis=1)
                if (same >= need).any():
                    forest.link(place, others[same >= need])
        moved = forest.label != np.arange(len(rep))
        if moved.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[moved]), pa.array(rep[forest.label[moved]])], names=["rep", "root"]
            )


def intersections(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each of ``rows`` the number of values it shares with every set, exactly.

    Values that many sets have go through blocks of a matrix product, the others through lists of
    the sets that have them.
    """
    count = len(offsets) - 1
    owner = np.repeat(np.arange(count), np.diff(offsets))
    _, value, often = np.unique(flat, return_inverse=True, return_counts=True)
    frequent = often > max(count // 8, 4)
    column = np.cumsum(frequent) - 1
    dense = np.zeros((count, int(frequent.sum())), dtype=np.float32)
    hit = frequent[value]
    dense[owner[hit], column[value[hit]]] = 1
    rare = ~hit & (often[value] > 1)
    order = np.argsort(value[rare], kind="stable")
    posting, posted = owner[rare][order], value[rare][order]
    # of each rare value of a set, the range of sets that have it
    begin, end = np.searchsorted(posted, value, side="left"), np.searchsorted(posted, value, side="right")
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        shared = (dense[part] @ dense.T).astype(np.int64)
        for k, row in enumerate(part.tolist()):
            own = np.arange(offsets[row], offsets[row + 1])[rare[offsets[row] : offsets[row + 1]]]
            if len(own):
                near = np.concatenate([posting[begin[i] : end[i]] for i in own.tolist()])
                shared[k] += np.bincount(near, minlength=count)
            yield shared[k]


def _exact(similarity: Fraction):
    p, q = similarity.numerator, similarity.numerator + similarity.denominator

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, side, rep, copies, shingles): links of each set in the group, and its tree's smallest."""
        for group in groups(batches):
            rep = np.asarray(group.column(2))
            group = group.take(pa.array(np.unique(rep, return_index=True)[1]))  # equal rows are one
            side, rep, copies = (np.asarray(group.column(i)) for i in (1, 2, 3))
            flat, offsets = _lists(group.column(4))
            size = np.diff(offsets)
            first, second = np.flatnonzero(side < 1), np.flatnonzero(side == 1)
            texts, documents = np.zeros(len(rep), dtype=np.int64), np.zeros(len(rep), dtype=np.int64)
            forest = Forest(len(rep))
            against = np.zeros(len(rep), dtype=bool)
            against[first if side[0] == ALONE else second] = True
            for place, shared in zip(first.tolist(), intersections(flat, offsets, first), strict=True):
                linked = (q * shared >= p * (size + size[place])) & against
                linked[place] = False
                others = np.flatnonzero(linked)
                if len(others):
                    texts[place] += len(others)
                    documents[place] += copies[others].sum()
                    if len(second):
                        texts[others] += 1
                        documents[others] += copies[place]
                    forest.link(place, others)
            arrays = [pa.array(a) for a in (rep, rep[forest.label], texts, documents)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rep", "root", "texts", "documents"])

    return exact


def block_pairs(rows: DataFrame, group: str, blocks: str, *columns: str) -> DataFrame:
    """Each row once for every pair of blocks that its own is in: ``group``, ``side`` and ``columns``.

    Every two rows of a group meet exactly once; a group of one block stays one group.  The side is ``ALONE``
    where a block meets itself; a block that meets an empty one has side 0 only, and nothing to be compared with.
    """
    own = F.pmod(F.xxhash64("rep"), F.col(blocks))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1),
        lambda other: F.struct(
            F.xxhash64(F.col(group), F.least(own, other), F.greatest(own, other)).alias("group"),
            F.when(own == other, ALONE).otherwise((own > other).cast("int")).alias("side"),
        ),
    )
    each = rows.withColumn("pair", F.explode(pairs)).select("pair.group", "pair.side", *columns)
    return each.repartition("group").sortWithinPartitions("group", "side", "rep")


def _bucketed(reps: DataFrame) -> DataFrame:
    """Sets (rep, tokens) in the buckets where the paths of their runs end: ``bucket``, ``blocks``, rep, tokens.

    Only buckets of more than one set are kept; those that are still large are compared in blocks.
    """
    paths = []
    for run in range(RUNS):
        keys, key = [], F.lit(run).cast("bigint")
        for level in range(LEVELS):
            key = F.xxhash64(key, F.element_at("tokens", run * LEVELS + level + 1))
            keys.append(key.alias(f"key{level}"))
        paths.append(F.struct(*keys))
    level = reps.select("rep", F.explode(F.array(*paths)).alias("path")).select("rep", "path.*")
    found = []
    for depth in range(LEVELS):
        name = f"key{depth}"
        sizes = level.groupBy(name).agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
        counted = level.join(sizes.withColumnRenamed(name, "bucket"), F.col(name) == F.col("bucket"))
        last = depth == LEVELS - 1
        ended = counted if last else counted.filter(F.col("sets") <= BUCKET)
        found.append(ended.select("bucket", F.ceil(F.col("sets") / BLOCK_SETS).alias("blocks"), "rep"))
        if not last:
            level = stored(counted.filter(F.col("sets") > BUCKET).select("rep", *[f"key{d}" for d in range(depth, LEVELS)]))
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    return buckets.join(reps, "rep")


def join(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """Per row: key, ``class_id``, ``links`` (other rows of at least that similarity), ``linked_texts``.

    ``class_id`` is the smallest id of all rows connected by links; ``linked_texts`` counts different
    texts with another set.  ``first`` marks one row of each class, one with the smallest id;
    ``text_hash`` tells rows of one id apart.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    base = stored(rows.mapInArrow(_describe(words), SETS).withColumn("node", F.monotonically_increasing_id()))
    one_set = ["set_high", "set_low"]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    classes = stored(
        base.groupBy(*one_set).agg(
            F.min("node").alias("rep"), F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")
        )
    )
    own = base.select(F.col("node").alias("rep"), "doc_id", "text_hash", "size", "tokens")
    reps = stored(classes.select("rep", "copies").join(own, "rep").filter("size > 0"))
    loose = block_pairs(_bucketed(reps.select("rep", "tokens")), "bucket", "blocks", "rep", "tokens")
    near = components(stored(loose.mapInArrow(_loose, "rep bigint, root bigint").distinct()), "rep", "root")
    # exact comparison of all pairs within a component of loose links
    members = stored(near.withColumnRenamed("node", "rep").join(reps.drop("tokens"), "rep"))
    blocks = members.groupBy("label").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks"))
    wanted = members.join(blocks, "label").select(
        "label", "blocks", "rep", "copies", F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")
    )
    same_row = (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    # the texts are shuffled once at every size; without the hint a small table would be broadcast
    texts = rows.join(wanted.hint("merge"), same_row).select("label", "blocks", "rep", "copies", "text")
    sets = texts.mapInArrow(_with_sets(words), "label bigint, blocks bigint, rep bigint, copies bigint, shingles array<bigint>")
    pairs = block_pairs(sets, "label", "blocks", "rep", "copies", "shingles")
    exact = _exact(Fraction(similarity).limit_denominator(1000))
    compared = stored(pairs.mapInArrow(exact, "rep bigint, root bigint, texts bigint, documents bigint"))
    counts = compared.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    trees = components(compared.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    of_class = (
        classes.join(trees, "rep", "left")
        .join(counts, "rep", "left")
        .select(
            *one_set,
            "copies",
            "first",
            F.coalesce("label", "rep").alias("root"),
            F.coalesce("texts", F.lit(0)).alias("linked_texts"),
            F.coalesce("documents", F.lit(0)).alias("others"),
        )
    )
    firsts = of_class.groupBy("root").agg(F.min("first").alias("lead"))
    named = of_class.join(firsts, "root").drop("root", "first")
    return base.select("doc_id", "text_hash", "node", *one_set).join(named, one_set).select(
        F.col("doc_id").alias(key),
        F.col("lead.doc_id").alias("class_id"),
        (F.col("copies") - 1 + F.col("others")).cast("bigint").alias("links"),
        F.col("linked_texts").cast("bigint"),
        (F.col("node") == F.col("lead.node")).alias("first"),
        "text_hash",
    )


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class of near duplicates, one with the smallest id."""
    own_id, own_hash = fresh("own_id", df.columns), fresh("own_hash", df.columns)
    kept = join(df, key, text).filter("first").select(F.col(key).alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    rows = df.withColumns({own_id: F.col(f"`{key}`").cast("bigint"), own_hash: F.xxhash64(F.col(f"`{text}`"))})
    same = F.col(own_id).eqNullSafe(F.col("kept_id")) & (F.col(own_hash) == F.col("kept_hash"))
    # equal rows all match the one that stays
    return rows.join(kept, same, "left_semi").dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)


def _with_sets(words: int):
    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, words).view(np.int64) for text in batch.column(4).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], lists], names=["label", "blocks", "rep", "copies", "shingles"]
            )

    return with_sets
