"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences, at line ends and after full stops, question and exclamation marks.  Three
sorts of runs are hashed, and all runs of all documents are joined by hash: every ``SPAN`` consecutive
sentences of at least ``LEAST_WORDS`` words together (three short sentences in a row repeat by chance); from
every sentence on, the shortest run of whole sentences that has ``ENOUGH`` words, if it is shorter than
``SPAN`` sentences or these have too few words; and ``ENOUGH`` words from the word on that has the smallest
hash of any ``WINDOW`` words.  The first occurrence, by document id and place, stays; the words of every other
occurrence are removed.

So a passage of ``SPAN`` whole sentences that stands in several places survives in one only, unless its places overlap: of
six equal sentences in a row the runs after the first take all but the first sentence.  So does a passage of
``WINDOW + ENOUGH - 1 = 39`` words or more, however it is cut or punctuated, but for up to ``WINDOW - 1`` words
at each end: where a run of the third sort begins depends on the words near by only, and a passage holds the same
ones everywhere.

Rows: NULL stays NULL, texts of fewer words and sentences than a run are left alone.  Rows with equal id and
text are one document, and keep or lose the same words.  NULL ids come last.  An empty table stays
empty.  Columns other than the text are left alone, but for those of the results' names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from veilwright.llm.common import ship, stored

SPAN, LEAST_WORDS = 3, 8
#: Words of a run that is not counted in sentences, and words of which one begins such a run.
ENOUGH, WINDOW = 20, 20
#: A sentence with the white space after it.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|\n\s*|[.!?]+|$)")
WORD = re.compile(r"\s*\S+\s*")
#: An occurrence: the run's hash, the document, and the run's number above 32 bits of the text's hash.
FOUND = "span bigint, doc_id bigint, spot bigint"
PLACE_UNIT = 1 << 32
#: Bits that tell spans which occur again from others: 16 MB, whatever the table holds.
MARKS = 1 << 27


def sentences(text: str) -> list[str]:
    """The sentences of ``text``, one after another, with all that is between them."""
    parts = [s for s in SENTENCE.findall(text) if s]
    joined: list[str] = []
    for part in parts:  # a full stop within a word, as in 3.14, ends no sentence
        if joined and not joined[-1][-1:].isspace():
            joined[-1] += part
        else:
            joined.append(part)
    return joined


def _begins(words: list[str]) -> np.ndarray:
    """Places of the last smallest hash of any ``WINDOW`` words."""
    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    # a hash above, a place counted backwards below; the least of so many from each on, doubled step by step
    least = np.fromiter(map(xxhash.xxh32_intdigest, words), dtype=np.uint64, count=len(words)) << np.uint64(32)
    least |= np.arange(PLACE_UNIT - 1, PLACE_UNIT - 1 - len(words), -1).astype(np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    least = PLACE_UNIT - 1 - (least & np.uint64(PLACE_UNIT - 1)).astype(np.int64)
    return least[np.append(True, np.diff(least) > 0)]


def runs(parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of the sentences ``parts``: their words in small letters, the words before each sentence and before
    the end, and first word and word after the last of all runs, in order."""
    split = [s.lower().split() for s in parts]
    words = [w for own in split for w in own]
    bounds = np.concatenate(([0], np.cumsum([len(own) for own in split], dtype=np.int64)))
    places = np.arange(len(parts))
    spanned = np.minimum(places + SPAN, len(parts))
    wordy = (places + SPAN <= len(parts)) & (bounds[spanned] - bounds[places] >= LEAST_WORDS)
    ends = np.searchsorted(bounds, bounds[:-1] + ENOUGH)
    enough = (ends < len(bounds)) & ((ends < places + SPAN) | ~wordy)
    begins = _begins(words)
    begins = begins[begins + ENOUGH <= len(words)]
    first = np.concatenate((bounds[places[wordy]], bounds[places[enough]], begins))
    last = np.concatenate((bounds[spanned[wordy]], bounds[ends[enough]], begins + ENOUGH))
    found = np.unique(first * (len(words) + 1) + last)
    return words, bounds, found // (len(words) + 1), found % (len(words) + 1)


def spans(text: str | None) -> tuple[list[int], list[int]]:
    """Numbers and hashes of all runs."""
    words, _, first, last = runs(sentences(text or ""))
    digests = [
        xxhash.xxh3_64_intdigest(" ".join(words[a:b])) for a, b in zip(first.tolist(), last.tolist(), strict=True)
    ]
    return list(range(len(digests))), np.array(digests, dtype=np.uint64).view(np.int64).tolist()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every hash of a batch once, and whether it stands there more than once."""
    for batch in batches:
        found = [spans(text)[1] for text in batch.column(0).to_pylist()]
        span, counts = np.unique(np.concatenate([np.array(f, dtype=np.int64) for f in found] or [[]]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(span.astype(np.int64)), pa.array(counts > 1)], names=["span", "again"])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, places, hashes = [], [], []
        for text in batch.column(2).to_pylist():
            at, span = spans(text)
            counts.append(len(at))
            places += at
            hashes += span
        row = pa.array(np.repeat(np.arange(len(counts)), counts))
        digest = np.asarray(batch.column(1).take(row)).astype(np.int64)
        spots = np.array(places, dtype=np.int64) * PLACE_UNIT + digest
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int64()), batch.column(0).take(row), pa.array(spots)], names=["span", "doc_id", "spot"]
        )


def cut_out(text: str, places: list[int]) -> tuple[str, int, int]:
    """``text`` without the runs numbered ``places``, the number of sentences that lost words, and that of all."""
    parts = sentences(text)
    if not places:
        return text, 0, len(parts)
    words, bounds, first, last = runs(parts)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, first[places], 1)
    np.add.at(change, last[places], -1)
    gone = np.cumsum(change)[:-1] > 0
    kept, removed = [], 0
    for part, a, b in zip(parts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        lost = int(gone[a:b].sum())
        removed += lost > 0
        if not lost:
            kept.append(part)
        elif lost < b - a:
            kept += [w for w, g in zip(WORD.findall(part), gone[a:b].tolist(), strict=True) if not g]
    return "".join(kept), removed, len(parts)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [
            cut_out(text, places or []) if text is not None else (None, 0, 0)
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        ]
        texts, removed, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())],
            names=["row", "text", "removed", "sentences"],
        )


def _digest(text: str) -> Column:
    """32 bits of a text's hash, which tell texts of one id apart."""
    return F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(PLACE_UNIT))


def _marks(spans_again: DataFrame) -> DataFrame:
    """One row: a bitmap of ``MARKS`` bits in which every span of the table has its bit."""
    place = F.pmod("span", F.lit(MARKS))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("span", F.lit(64)).cast("int"))
    marks = spans_again.select(F.floor(place / 64).alias("word"), one.alias("bits"))
    none = spans_again.sparkSession.range(MARKS // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = marks.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences (doc_id, digest, place) of every span but its first.

    In a first pass only the hashes are counted, each once a batch.  Those that occur again set bits in a bitmap of
    fixed size, and in a second pass, which finds the runs anew, only runs with their bit set are written down; the
    few that have it by chance go when the occurrences are counted.  With many more repeated spans than bits
    more runs pass, and the result stays the same.  A passage that stands in a third of all documents is a row
    a batch where it is counted, and its occurrences are split over tasks where they meet their first.
    """
    ship(df.sparkSession)
    hashes = df.select(F.col(f"`{text}`")).mapInArrow(_hashes, "span bigint, again boolean")
    counted = hashes.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
    marks = stored(_marks(counted.filter((F.col("n") > 1) | F.col("again")).select("span")))
    rows = df.select(F.col(f"`{key}`").cast("bigint"), _digest(text), F.col(f"`{text}`"))
    word = F.get(marks.scalar(), F.floor(F.pmod("span", F.lit(MARKS)) / 64).cast("int"))
    marked = F.getbit(word, F.pmod("span", F.lit(64)).cast("int")) == 1
    seen = stored(rows.mapInArrow(_find, FOUND).filter(marked))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "spot")
    firsts = seen.groupBy("span").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the fingerprint keeps the join from reusing the partitions of the aggregate: so a hot span can be split
    firsts = firsts.select(F.col("span").alias("of"), "first", F.xxhash64(F.lit("meet"), "span").alias("print"))
    same = (F.col("span") == F.col("of")) & (F.xxhash64(F.lit("meet"), "span") == F.col("print"))
    later = seen.join(firsts, same).filter(order != F.col("first"))
    return later.select(
        "doc_id",
        F.pmod("spot", F.lit(PLACE_UNIT)).alias("digest"),
        F.shiftright("spot", 32).cast("int").alias("place"),
    )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated passages removed from ``text``; adds ``removed`` and ``sentences``.

    These are the numbers of sentences that lost words, all or some, and of all sentences.
    """
    columns = [c for c in df.columns if c.lower() not in ("removed", "sentences")]
    places = repeats(df, key, text).groupBy("doc_id", "digest").agg(F.collect_set("place").alias("places"))
    # a row has at most as many places as words and sentences
    rows = df.select(
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in columns if c != text]).alias("row"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{key}`").cast("bigint").alias("own_id"),
        _digest(text).alias("own_digest"),
    )
    same = (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
    joined = rows.join(places, same, "left").select("row", "text", "places")
    schema = StructType().add("row", joined.schema["row"].dataType).add("text", StringType())
    done = joined.mapInArrow(_clean, schema.add("removed", LongType()).add("sentences", LongType()))
    kept = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns]
    return done.select(*kept, "removed", "sentences")
