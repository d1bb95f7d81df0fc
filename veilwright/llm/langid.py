"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of ``WINDOW`` bytes that overlap by the widest filter.  Filters of several
widths slide over the bytes of a window (for each width and place in the filter a table gives every
byte's contribution), each filter keeps its largest response, and a softmax layer turns these into
probabilities.  The logarithms of a text's windows are averaged, weighted by their bytes, so the whole
text counts whatever its length.

The network is fitted on the driver on a bounded sample: ``SAMPLE`` labelled rows of each language,
those with the smallest hash, ``SAMPLE_WINDOWS`` windows of each, evenly spread over the text.  It is
sent to the tasks as it is; its size depends on nothing but the number of languages.

Rows: a NULL text and a text without a letter are ``UNKNOWN`` with score 0.  Rows without a label are
predicted but not learned from.  With no labelled text at all, every row is ``UNKNOWN``.  Repeated rows
and NULL ids are rows like any other.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from veilwright.llm.common import ship

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE, SAMPLE_WINDOWS = 600, 4
PASSES, BATCH, RATE = 3, 64, 0.004
#: Hashes of ids are ranked by their remainder by this.
HASHES = 1 << 32
#: Windows that go through the network at a time.
BLOCK = 1024
OVERLAP = max(WIDTHS) - 1


@dataclass
class Network:
    """Languages, byte tables (width by width: place, byte, filter), biases and the softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray
    training: bool = False

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter in every window, cut at 0, and where it was found."""
        pooled, places = [], []
        for table, bias in zip(self.tables, self.biases, strict=True):
            steps = windows.shape[1] - len(table) + 1
            total = table[0][windows[:, :steps]]
            for place in range(1, len(table)):
                total += table[place][windows[:, place : place + steps]]
            if self.training:
                places.append(total.argmax(axis=1))
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(pooled, axis=1), places

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = self.responses(windows)[0] @ self.weights + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all of each text ``data[start:end]``, the text of each window, and its bytes.

    The last window of a text is filled up with zeros.
    """
    stride = WINDOW - OVERLAP
    counts = np.maximum(-(-(ends - starts - OVERLAP) // stride), 1)
    text = np.repeat(np.arange(len(starts)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[text] + number * stride
    size = np.minimum(ends[text] - begin, WINDOW)
    at = begin[:, None] + np.arange(WINDOW)
    windows = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(at.shape, dtype=np.uint8)
    windows[np.arange(WINDOW) >= size[:, None]] = 0
    return windows, text, size


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network | None:
    """Fit the network to whole windows of the given texts by Adam on the cross-entropy."""
    languages = sorted(set(labels))
    if not languages:
        return None
    draw = np.random.default_rng(seed)
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        spots = np.linspace(0, max(len(text) - WINDOW, 0), SAMPLE_WINDOWS).astype(int)
        for spot in np.unique(spots).tolist():
            part = text[spot : spot + WINDOW]
            windows.append(np.frombuffer(part.ljust(WINDOW, b"\0"), dtype=np.uint8))
            target.append(languages.index(label))
            if len(part) > 48:  # short texts are predicted too: learn from short windows as well
                short = part[: int(draw.integers(12, len(part)))]
                windows.append(np.frombuffer(short.ljust(WINDOW, b"\0"), dtype=np.uint8))
                target.append(languages.index(label))
    data, wanted = np.stack(windows), np.array(target)
    net = Network(
        languages,
        [draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
        training=True,
    )
    values = [*net.tables, *net.biases, net.weights, net.offset]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    balance = len(wanted) / (np.bincount(wanted, minlength=len(languages)) * len(languages))
    steps = 0
    for _ in range(PASSES):
        order = draw.permutation(len(data))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            x, y = data[chosen], wanted[chosen]
            pooled, places = net.responses(x)
            scores = pooled @ net.weights + net.offset
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = scores / scores.sum(axis=1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            error *= (balance[y] / len(y))[:, None].astype(np.float32)
            back = (error @ net.weights.T) * (pooled > 0)
            slopes: list[np.ndarray] = []
            for k, (table, place) in enumerate(zip(net.tables, places, strict=True)):
                part, slope = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(table)
                for j in range(len(table)):
                    byte = x[np.arange(len(y))[:, None], place + j]
                    np.add.at(slope[j], (byte, np.arange(FILTERS)), part)
                slopes.append(slope)
            slopes += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            slopes += [pooled.T @ error, error.sum(axis=0)]
            steps += 1
            for value, slope, m, v in zip(values, slopes, first, second, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    net.training = False
    return net


def fit(df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> Network | None:
    """Train on ``SAMPLE`` rows of each language: those whose id has the smallest hash.

    The languages are counted first, so that each keeps about twice ``SAMPLE`` rows before they are
    ranked: what is shuffled depends on the number of languages, not on that of rows or tasks.
    """
    rows = df.select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{order}`")).alias("hash")
    )
    known = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    room = {name: int(min(1.0, 2 * SAMPLE / n) * HASHES) for name, n in counts.items()}
    limits = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
    # the first ranks of the hash in unsigned order, whole where there are few rows
    near = known.filter(F.pmod("hash", F.lit(HASHES)) < F.element_at(limits, F.col("lang")))
    # of a sampled text only the windows it is learned from travel
    last = F.greatest(F.length("text") - WINDOW, F.lit(0))
    shares = [i / (SAMPLE_WINDOWS - 1) for i in range(SAMPLE_WINDOWS)]
    spots = [F.substring("text", (last * F.lit(share)).cast("int") + 1, F.lit(WINDOW)) for share in shares]
    parts = near.select("lang", F.pmod("hash", F.lit(HASHES)).alias("hash"), F.array_distinct(F.array(*spots)).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "parts"))
    kept = parts.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE)
    found = sorted((r.lang, r.hash, r.parts) for r in kept.collect())
    texts = [(label, part) for label, _, windows in found for part in windows]
    return train([part.encode() for _, part in texts], [label for label, _ in texts])


def _predictor(net: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n = len(texts)
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
            best, score = np.full(n, -1), np.zeros(n)
            if net is not None and lettered.any():
                best[lettered], score[lettered] = classify(net, texts.filter(pa.array(lettered)))
            names = pa.array([net.languages[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], names, pa.array(score, pa.float64())], names=["row", "lang_pred", "score"]
            )

    return predict


def classify(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text, and its probability."""
    texts = pa.concat_arrays([texts]).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    total, weight = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    a = 0
    while a < len(texts):  # as many texts at a time as fill a few blocks
        b = int(np.searchsorted(offsets, offsets[a] + 8 * BLOCK * WINDOW, side="right"))
        b = min(max(b - 1, a + 1), len(texts))
        windows, text, size = cut(data, offsets[a:b], offsets[a + 1 : b + 1])
        for begin in range(0, len(windows), BLOCK):
            part = slice(begin, begin + BLOCK)
            logs = net.log_probabilities(windows[part]) * size[part, None]
            np.add.at(total, text[part] + a, logs)
            np.add.at(weight, text[part] + a, size[part])
        a = b
    mean = total / np.maximum(weight, 1)[:, None]
    share = np.exp(mean - mean.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return share.argmax(axis=1), share.max(axis=1)


def identify(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all rows; shuffles nothing.  Columns of these names are replaced."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    own = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = df.select(own.alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType().add("row", rows.schema["row"].dataType)
    schema = schema.add("lang_pred", StringType()).add("score", DoubleType())
    done = rows.mapInArrow(_predictor(net), schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], "lang_pred", "score")
