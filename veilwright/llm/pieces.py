"""SentencePiece ids of whole texts with the bytes of the source that each piece stands for, and texts from ids.

A text is normalised as its model says: at each place the longest entry of the model's compiled character map
that the rest of the text begins with is replaced (a character without an entry stands for itself), white space
becomes the space mark, and a mark is put before the text.  Every byte of the normalised text records the
source offset of what it came from.  The pieces lie end to end in the normalised text, so their ends, looked up in
that record, give each piece's bytes in the source: what ``starts`` and ``ends`` hold, in UTF-8 bytes.  All but the last
byte piece of an unknown character stand for no bytes.  If the pieces did not cover the normalised text exactly, the
task would stop with an error.

A text that does not meet the map, of a model that leaves runs of spaces alone, changes in its spaces only; the
records of such texts are made for a whole batch at once, those of others one by one.  Only the merges of pieces, and
the way back from ids to text, are the library's.

The model is a file that every worker can read; its path is a parameter.  Rows: NULL is an empty text, an empty text has
no ids.  Repeated rows and NULL keys are rows like any other, an empty table gives no rows, and texts of any length are
encoded whole.  ``encode`` reads the key and the text only; ``decode`` keeps all columns and adds one.  Models that
put the mark after a word are refused.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import ship

#: Text bytes handled at a time.
CHUNK_BYTES = 1 << 20
#: Fixed value: the space mark.
SPACE_MARK = "▁"
#: Field numbers of the model file.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_KIND, BYTE_PIECE = 3, 6
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE, SUFFIX = 2, 3, 4, 5, 24


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = number(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, whose leaves point into replacement texts."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").astype(np.int64)
        self.texts = compiled[4 + size :]
        #: bytes that an entry can begin with
        self.first = set(self._entered(0, bytes(range(256)))) if len(self.units) else set()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _entered(self, node: int, labels: bytes) -> list[int]:
        base = node ^ self._offset(int(self.units[node]))
        return [b for b in labels if (base ^ b) < len(self.units) and int(self.units[base ^ b]) & 0x800000FF == b]

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """Bytes of the longest entry that stands at ``at``, and where its replacement starts."""
        node = self._offset(int(self.units[0]))
        found = None
        for end in range(at, len(text)):
            node ^= text[end]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != text[end]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, int(self.units[node]) & 0x7FFFFFFF
        return found

    def replacement(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]


class Normalizer:
    def __init__(self, spec: bytes):
        named = dict(fields(spec))
        compiled = named.get(CHARACTER_MAP, b"")
        self.map = CharacterMap(compiled) if compiled else None
        self.prefix, self.squeeze, self.escape = (bool(named.get(n, 1)) for n in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))

    def _steps(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        """What stands for each stretch of the source, and how many bytes that has."""
        at = 0
        while at < len(text):
            lead = text[at]
            match = self.map.longest(text, at) if self.map and lead in self.map.first else None
            if match:
                size, place = match
                yield self.map.replacement(place), size
            else:
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield text[at : at + size], size
            at += size

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source offset of each of its bytes and of its end."""
        source, mark = text.encode(), SPACE_MARK.encode() if self.escape else b" "
        out, origin, at = bytearray(), array("q"), 0
        before_space = self.squeeze  # spaces at the front are extra ones
        started = False
        for step, size in self._steps(source):
            if self.squeeze and before_space:
                step = step.lstrip(b" ")
            if step or not self.squeeze:
                if not started and self.prefix:
                    out += mark
                    origin.extend([at] * len(mark))
                started = True
                shown = step.replace(b" ", mark)
                out += shown
                origin.extend([at] * len(shown))
                before_space = self.squeeze and step.endswith(b" ")
            at += size
        end = at
        if self.squeeze:
            while out.endswith(mark) and len(out):
                del out[-len(mark) :]
                end = origin[-1]
                del origin[-len(mark) :]
        origin.append(end)
        return bytes(out), np.frombuffer(origin, dtype=np.int64)


class Pieces:
    """A model's pieces, and the ids and source bytes of batches of texts."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        parts = list(fields(self.library.serialized_model_proto()))
        if dict(fields(dict(parts).get(TRAINER, b""))).get(SUFFIX, 0):
            raise ValueError("models that put the space mark after a word are not supported")
        self.normalizer = Normalizer(dict(parts).get(NORMALIZER, b""))
        named = [dict(fields(p)) for n, p in parts if n == PIECE]
        self.bytes_of = np.array([1 if p.get(PIECE_KIND) == BYTE_PIECE else len(p.get(PIECE, b"")) for p in named], dtype=np.int32)
        self.unknown = self.library.unk_id()
        #: whether a text that does not meet the map changes in its spaces only
        self.plain = self.normalizer.prefix and self.normalizer.escape and not self.normalizer.squeeze
        self.mapped = np.zeros(256, dtype=bool)
        self.mapped[sorted(self.normalizer.map.first) if self.normalizer.map else []] = True

    def _lengths(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bytes of each piece in the normalised texts."""
        sizes = self.bytes_of[ids]
        if (ids == self.unknown).any():  # such a piece stands for whatever it met
            ends = np.cumsum(counts)
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.unknown), side="right")).tolist():
                surfaces = self.library.encode(texts[i], out_type=str)
                sizes[ends[i] - counts[i] : ends[i]] = [len(s.encode()) for s in surfaces]
        return sizes

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the texts in a row, and where each text starts; the last number is the end."""
        data = texts.cast(pa.large_binary())
        edges = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
        return np.frombuffer(data.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]], edges - edges[0]

    def _origins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Source offsets of all normalised bytes and ends of texts that change in spaces only, and where each text starts."""
        # with the mark before a text and one byte after its end, each byte is one or as many as the mark has
        source, edges = self._bytes(pc.binary_join_element_wise(" ", texts, "\0", ""))
        at = np.arange(len(source), dtype=np.int32)
        whole = np.maximum.accumulate(np.where(source & 0xC0 != 0x80, at, 0))
        own = np.maximum(whole - np.repeat(edges[:-1].astype(np.int32), np.diff(edges)) - 1, 0)
        shown = np.where(source == 32, np.int8(len(SPACE_MARK.encode())), np.int8(1))
        return np.repeat(own, shown), np.concatenate(([0], np.cumsum(shown, dtype=np.int64)))[edges]

    def _normalised(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_origins``, for all texts."""
        source, edges = self._bytes(texts)
        hits = np.concatenate(([0], np.cumsum(self.mapped[source])))[edges]
        odd = np.diff(hits) > 0 if self.plain else np.ones(len(texts), dtype=bool)
        if not odd.any():
            return self._origins(texts)
        parts = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            parts[i] = self.normalizer.apply(texts[i].as_py())[1]
        if not odd.all():
            origin, starts = self._origins(texts.filter(pa.array(~odd)))
            for i, start, end in zip(np.flatnonzero(~odd).tolist(), starts, starts[1:], strict=False):
                parts[i] = origin[start:end]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of all pieces of non-empty texts, and ids a text."""
        if not len(texts):
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        strings = texts.to_pylist()
        found = self.library.encode(strings, num_threads=1)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=counts.sum())
        upto = np.concatenate(([0], np.cumsum(self._lengths(strings, ids, counts), dtype=np.int64)))
        origin, base = self._normalised(texts)
        first = np.cumsum(counts) - counts
        # each text's pieces must end where its normalised text does
        if (upto[first + counts] - upto[first] + 1 != np.diff(base)).any():
            raise ValueError("pieces do not cover the normalised text")
        shift = np.repeat(base[:-1] - upto[first], counts)
        return ids, origin[upto[:-1] + shift], origin[upto[1:] + shift], counts


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """One per worker process."""
    return Pieces(model)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``CHUNK_BYTES``, a longer row on its own."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > CHUNK_BYTES and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
            for part in _parts(batch, lengths):
                texts = pc.fill_null(part.column(1).cast(pa.string()), "")
                some = np.asarray(pc.binary_length(texts)) > 0
                *columns, counts = pieces(model).encode(texts.filter(pa.array(some)))
                every = np.zeros(len(texts), dtype=np.int64)
                every[some] = counts
                offsets = pa.array(np.concatenate(([0], np.cumsum(every))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=[batch.schema.names[0], "ids", "starts", "ends"])

    return run


def _decode(model: str, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0))
            for part in _parts(batch, 4 * lengths):
                flat = np.asarray(part.column(at).flatten()).tolist()
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part.column(at)), 0))).tolist()
                found = pieces(model).library.decode([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, name])

    return run


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``ids``, ``starts`` and ``ends`` of every text: ids without begin or end, and the source bytes of each."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text" if key != "text" else "_text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_encode(model), f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text of ``ids`` under a name that must be free; NULL is no ids."""
    ship(df.sparkSession)
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name!r} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_decode(model, df.columns.index(ids), name), f"{schema}, `{name}` string")
