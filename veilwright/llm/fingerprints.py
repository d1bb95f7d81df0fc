"""Document fingerprints by a randomised edit embedding.

A walk goes over the text with one shared random decision per step and symbol: at each step it
writes the symbol under it and then stays or moves one on.  Two texts that agree are written alike,
and after an insertion or deletion two walks fall into step again: edit distance becomes Hamming
distance.  A symbol is a character together with the few before it, hashed to 16 bits, so unrelated
texts rarely agree.

A fingerprint samples the walk at shared steps, ``SAMPLES`` for the text's length class and as many
for the next longer one, so texts of similar length have a class in common.  ``likeness`` is the share
of equal samples there, of those where not both walks have ended.  ``near_groups`` finds alike
fingerprints by bands of samples at places drawn at random and verifies them.

Rows: NULL and empty texts have a fingerprint of ended samples; two of them are alike (1), one and any
other text are not (0), and neither are texts more than a length class apart.  Equal texts have equal
fingerprints.  NULL ids come first; rows with one id are ordered by a hash of the text.  An empty table
stays empty.  Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.common import ship, stored
from veilwright.llm.components import components
from veilwright.llm.jaccard import ALONE, BLOCK_SETS, Forest, block_pairs, groups

#: Samples of a walk in each of the two length classes of a fingerprint.
SAMPLES = 96
#: Characters hashed into one symbol.
CONTEXT = 6
#: Texts of up to so many characters are of length class 0; each doubling is one class more.
SHORT = 64
#: Characters walked at a time.
CHUNK_CHARS = 12 << 20
#: Consecutive ids that are ordered in one task, and so many first ids that may be broadcast.
CELL_BITS = 11
FIRSTS = 1_000_000
#: Steps between looks at which walks have ended.
LOOK = 64
#: Samples in a band, each band of places drawn at random, and the likeness from which two fingerprints are linked.  Of
#: pairs of 240 characters with one edit, 0.96 have that likeness and 0.998 share a band; unrelated texts reach 0.04.
BAND, ALIKE = 4, 0.3
ENDED = 0
SEED = 20_251


def length_class(chars: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(chars, SHORT) / SHORT)).astype(np.int64)


@lru_cache(maxsize=64)
def sampled_steps(level: int) -> np.ndarray:
    """The steps, in order, at which walks of a length class are sampled: a walk takes two a character."""
    horizon = 2 * SHORT << level
    return np.sort(np.random.default_rng([SEED, level]).choice(horizon, size=SAMPLES, replace=False))


@lru_cache(maxsize=1)
def band_places() -> np.ndarray:
    """Places of the samples of each band, every place in one band."""
    return np.random.default_rng([SEED, SAMPLES]).permutation(SAMPLES).reshape(-1, BAND)


@lru_cache(maxsize=4)
def decisions(steps: int) -> np.ndarray:
    """An odd factor per step; the top bit of factor times symbol says whether the walk moves on."""
    x = np.arange(SEED, SEED + steps, dtype=np.uint32) * np.uint32(0x9E3779B1)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # fixed values of a public integer hash
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16)) | np.uint32(1)


def symbols(chars: np.ndarray) -> np.ndarray:
    """16 bits from each code point and those before it, never ``ENDED``."""
    total = np.zeros(len(chars), dtype=np.uint32)
    for back in range(min(CONTEXT, len(chars))):
        factor = np.uint32(pow(0x9E3779B1, back + 1, 1 << 32))
        total[back:] += (chars[: len(chars) - back] + np.uint32(1)) * factor
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    return ((total >> np.uint32(16)) % np.uint32(65_535) + np.uint32(1)).astype(np.uint16)


def walk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length class of every text, and its samples as an array (texts, 2, SAMPLES) of 8-bit values.

    All texts walk in step.  Behind each stands a symbol on which no walk moves; walks found there
    are left out from then on, their samples stay ``ENDED``.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    levels = length_class(lengths)
    out = np.zeros((len(texts), 2, SAMPLES), dtype=np.uint8)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    flat = np.zeros(int((lengths + 1).sum()), dtype=np.uint16)
    for start, text in zip(starts.tolist(), texts, strict=True):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        flat[start : start + len(chars)] = symbols(chars)
    if not len(texts):
        return levels, out
    row = np.argsort(levels, kind="stable")
    at, level = starts[row], levels[row]
    wanted: dict[int, list[tuple[int, int]]] = {}
    for one in range(int(level[-1]) + 2):
        for place, step in enumerate(sampled_steps(one).tolist()):
            wanted.setdefault(step, []).append((one, place))
    last = max(wanted)
    factor = decisions(1 << int(last).bit_length())
    top = np.uint32(31)
    for step in range(last + 1):
        if step % LOOK == 0:
            going = flat[at] != ENDED
            if not going.all():
                at, row, level = at[going], row[going], level[going]
            if not len(at):
                break
        here = flat[at].astype(np.uint32)
        for one, place in wanted.get(step, ()):
            for slot in (0, 1):  # as their own class, and as the next longer one
                a, b = np.searchsorted(level, (one - slot, one - slot + 1))
                if a < b:
                    seen = here[a:b]
                    out[row[a:b], slot, place] = np.where(seen == ENDED, ENDED, seen % 255 + 1)
        at += (here * factor[step]) >> top
    return levels, out


def written(levels: np.ndarray, samples: np.ndarray) -> list[str]:
    """Fingerprints as text: two hex digits of the class, then two for each sample."""
    return [f"{level:02x}{s.tobytes().hex()}" for level, s in zip(levels.tolist(), samples, strict=True)]


def likeness(level_a: np.ndarray, a: np.ndarray, level_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples in the classes two fingerprints have in common, row by row."""
    same = (level_a == level_b)[:, None]
    lower = (level_a + 1 == level_b)[:, None]
    upper = (level_a == level_b + 1)[:, None]
    first = np.where(lower, a[:, 1], a[:, 0]), np.where(upper, b[:, 1], b[:, 0])
    both = np.concatenate([first[0], np.where(same, a[:, 1], ENDED)], axis=1)
    other = np.concatenate([first[1], np.where(same, b[:, 1], ENDED)], axis=1)
    live = (both != ENDED) | (other != ENDED)
    share = ((both == other) & live).sum(axis=1) / np.maximum(live.sum(axis=1), 1)
    share[~live.any(axis=1)] = 1.0
    share[~(same | lower | upper)[:, 0]] = 0.0
    return share


def parsed(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class and samples of written fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    return raw[:, 0].astype(np.int64), raw[:, 1:].reshape(len(fingerprints), 2, SAMPLES)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of about ``CHUNK_CHARS`` characters at a time."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            rows.append(row)
            held += len(row[-1] or "")
            if held > CHUNK_CHARS:
                yield rows
                rows, held = [], 0
    yield rows


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        prints = written(*walk([text or "" for _, text in rows]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key for key, _ in rows], pa.int64()), pa.array(prints, pa.string())], names=["key", "print"]
        )


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` of every row; shuffles nothing."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`"))
    return rows.mapInArrow(_fingerprint, "key bigint, print string").toDF(key, "fingerprint")


def _edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    gone = len(text) // 4
    return text[: len(text) - gone] + following[:gone]


COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, extra, doc_id, text) in order; a cell ends with the first row of the next as an extra."""
    held: list[tuple] = []
    for rows in _chunks(batches):
        rows = held + rows
        held = rows[-1:]
        texts = [row[-1] or "" for row in rows]
        # a row and the one after it in the cell; an extra has no next
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            continue
        edits = [_edited(texts[i], texts[i + 1]) for i in pairs]
        levels, samples = walk(texts + edits)
        plain, now, after = np.arange(len(rows), len(rows) + len(pairs)), np.array(pairs), np.array(pairs) + 1
        prints = written(levels, samples)
        near_edited = likeness(levels[now], samples[now], levels[plain], samples[plain])
        near_next = likeness(levels[now], samples[now], levels[after], samples[after])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]),
                pa.array([prints[i] for i in pairs]),
                pa.array(prints[len(rows) :]),
                pa.array(near_edited, pa.float64()),
                pa.array(near_next, pa.float64()),
            ],
            names=[part.split()[0] for part in COMPARED.split(", ")],
        )


def _first_rows(keys: DataFrame) -> DataFrame:
    """First key of every cell and the cell before it; before the first comes the last.

    Cells are ordered within blocks of cells, and only the blocks all together.
    """
    cells = keys.groupBy("cell").agg(F.min("key").alias("first"))
    cells = cells.withColumn("block", F.shiftright("cell", CELL_BITS))
    blocks = cells.groupBy("block").agg(F.max("cell").alias("last"))
    order = Window.orderBy(F.col("block").asc_nulls_first())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(order)
    earlier = F.when(at == 1, F.last("last").over(whole)).otherwise(F.lag("last").over(order))
    blocks = blocks.select(F.col("block").alias("of_block"), earlier.alias("before_block"))
    inside = Window.partitionBy("block").orderBy(F.col("cell").asc_nulls_first())
    return (
        cells.withColumns({"number": F.row_number().over(inside), "previous": F.lag("cell").over(inside)})
        .join(blocks, F.col("block").eqNullSafe(F.col("of_block")))
        .select("first", F.when(F.col("number") == 1, F.col("before_block")).otherwise(F.col("previous")).alias("previous"))
    )


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (cell, extra, key, text) such that each cell is followed by the first row of the next one.

    The texts are shuffled once; the first keys are found from the key column alone.
    """
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("cell", F.shiftright("key", CELL_BITS))
    firsts = stored(_first_rows(rows.select("key", "cell")))
    firsts = F.broadcast(firsts) if firsts.count() <= FIRSTS else firsts
    own = F.struct(F.col("cell").alias("cell"), F.lit(False).alias("extra"))
    ahead = F.struct(F.col("previous").alias("cell"), F.lit(True).alias("extra"))
    is_first = F.col("found").isNotNull()
    joined = rows.join(
        firsts.withColumn("found", F.lit(True)), F.col("key").eqNullSafe(F.col("first")), "left"
    ).select("key", "text", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("place"))
    return (
        joined.select("place.cell", "place.extra", "key", "text")
        .repartition("cell")
        .sortWithinPartitions("cell", "extra", "key", F.xxhash64("text"))
    )


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text's are."""
    ship(df.sparkSession)
    return with_next(df, key, text).mapInArrow(_compare, COMPARED)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, side, rep, fingerprint): links of each to the smallest of its tree in the group."""
        for group in groups(batches):
            side, rep = np.asarray(group.column(1)), np.asarray(group.column(2))
            level, samples = parsed(group.column(3).to_pylist())
            forest, second = Forest(len(rep)), np.flatnonzero(side == 1)
            for place in np.flatnonzero(side < 1).tolist():
                others = np.arange(place + 1, len(rep)) if side[0] == ALONE else second
                others = others[forest.label[others] != forest.label[place]]
                if len(others):
                    own = np.full(len(others), place)
                    alike = likeness(level[own], samples[own], level[others], samples[others]) >= threshold
                    forest.link(place, others[alike])
            moved = forest.label != np.arange(len(rep))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[moved]), pa.array(rep[forest.label[moved]])], names=["rep", "root"]
            )

    return verify


def near_groups(df: DataFrame, threshold: float = ALIKE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` and ``group_id`` of every row: the smallest key of all rows linked to it.

    Equal fingerprints are one.  Fingerprints that share a band of samples which have not ended are
    compared, a large bucket in blocks, and those of at least the ``threshold`` are linked.  Texts that begin alike for
    a share of their length are alike by about that share: a higher threshold parts them, and loses more edited copies.
    """
    prints = stored(fingerprints(df, key, text).toDF("key", "print"))
    distinct = prints.groupBy("print").agg(F.min("key").alias("first"))
    distinct = stored(distinct.withColumn("rep", F.monotonically_increasing_id()))
    level = F.conv(F.substring("print", 1, 2), 16, 10).cast("int")
    bands = []
    for slot in (0, 1):
        for band, places in enumerate(band_places().tolist()):
            part = F.concat(*[F.substring("print", 3 + 2 * (slot * SAMPLES + place), 2) for place in places])
            bands.append(F.when(part != "00" * BAND, F.xxhash64(level + slot, F.lit(band), part)))
    rows = distinct.select("rep", "print", F.explode(F.array_compact(F.array(*bands))).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = sizes.select(F.col("bucket").alias("of"), F.ceil(F.col("n") / BLOCK_SETS).alias("blocks"))
    met = rows.join(blocks, F.col("bucket") == F.col("of"))
    pairs = block_pairs(met, "bucket", "blocks", "rep", "print")
    links = stored(pairs.mapInArrow(_verify(threshold), "rep bigint, root bigint").distinct())
    trees = components(links, "rep", "root").withColumnRenamed("node", "rep")
    labelled = distinct.join(trees, "rep", "left").withColumn("tree", F.coalesce("label", "rep"))
    names = labelled.groupBy("tree").agg(F.min("first").alias("group_id"))
    of_print = labelled.join(names, "tree").select(F.col("print").alias("of_print"), "group_id")
    return prints.join(of_print, F.col("print") == F.col("of_print")).select(
        F.col("key").alias(key), F.col("print").alias("fingerprint"), "group_id"
    )
