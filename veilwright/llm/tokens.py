"""Token ids of whole texts from a public vocabulary, as a column of arrays or as flat numpy arrays.

The vocabulary's rule cuts a text into words before any merge, so a word's ids do not depend on its
neighbours.  Batches are therefore cut into words, every distinct word is looked at once, and only
words not met before go through the tokenizer: those that begin with a space many at a time in one text, whose
ids are dealt out by the bytes that each id stands for.  Texts with white space in a row are cut by the rule
in Python instead of Arrow, and texts with characters beyond the Latin blocks are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time, and words remembered by a worker (twice that for a moment), of so many bytes at most.
CHUNK_BYTES = 4 << 20
REMEMBERED, REMEMBERED_BYTES = 350_000, 16 << 20
#: Words that the tokenizer gets in one text, and characters that it or the rule in Python gets at a time.
TOGETHER = 1000
AT_A_TIME = 1 << 18
#: White space, letters and digits below U+0250, as the vocabulary's rule sees them.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
DIGITS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
RULE = f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+"
WORDS = re.compile(f"{RULE}|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The same in RE2, for texts without white space in a row or at the end, where no look ahead is needed.
RE2_RULE = re.sub(r"\\(x|u0)([0-9a-f]{2,3})", r"\\x{\2}", f"{RULE}|[{SPACES}]")
MARK = "\0"
#: RE2: characters that the rule above does not know or that mark the cuts, and uncertain white space.
UNKNOWN = r"[^\x01-\x{24f}]"
UNCERTAIN = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}](?:[\x09-\x0d\x1c-\x20\x{85}\x{a0}]|$)"
#: A word of a space and something that is not white space.
SPACED = r"^ [^\x09-\x0d\x1c-\x20\x{85}\x{a0}]"
#: A number drawn for every byte at each of 64 places, and words that are marked at a time.
DRAWN = np.random.default_rng(64).integers(0, 1 << 64, 64 * 256, dtype=np.uint64)
MARKED = 1 << 14


def marks(words: pa.Array) -> np.ndarray:
    """A number for each word, by which it is looked up; different words hardly ever share one."""
    found = [np.zeros(0, dtype=np.uint64)]
    for start in range(0, len(words), MARKED):
        part = words.slice(start, MARKED)
        _, offsets, data = part.buffers()
        edges = np.frombuffer(offsets, dtype=np.int32)[part.offset : part.offset + len(part) + 1]
        held = np.frombuffer(data or b"", dtype=np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        place = np.arange(len(held), dtype=np.int32) - np.repeat(edges[:-1], np.diff(edges))
        drawn = DRAWN[((place & 63) << 8) | held] * (2 * (place >> 6) + 1).astype(np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(drawn))
        found.append(sums[edges[1:]] - sums[edges[:-1]])
    return np.concatenate(found)


class Memory:
    """Distinct words and their ids, flat: a few bytes a word instead of some objects.

    Words are found by their marks, kept in order, and then compared; no table of all words is made for each batch.
    """

    def __init__(self):
        self.marks = np.zeros(0, dtype=np.uint64)
        self.places = np.zeros(0, dtype=np.int32)
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, dtype="<u4")
        self.starts = np.zeros(0, dtype=np.int32)
        self.lengths = np.zeros(0, dtype=np.int32)

    def find(self, words: pa.Array, marked: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those not there or behind another word of the same mark."""
        found = np.full(len(words), -1, dtype=np.int64)
        if len(words) and len(self.words):
            order = np.argsort(marked)
            at = np.minimum(np.searchsorted(self.marks, marked[order]), len(self.marks) - 1)
            there = self.marks[at] == marked[order]
            order, at = order[there], self.places[at[there]]
            same = np.asarray(pc.equal(words.take(pa.array(order)), self.words.take(pa.array(at))))
            found[order[same]] = at[same]
        return found

    def add(self, words: pa.Array, marked: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Words that were not found."""
        if len(words):
            order = np.argsort(marked)
            before = np.searchsorted(self.marks, marked[order], side="right")
            self.marks = np.insert(self.marks, before, marked[order])
            self.places = np.insert(self.places, before, len(self.words) + order)
            self.words = pa.concat_arrays([self.words, words])
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.starts = np.concatenate((self.starts, starts.astype(np.int32)))
            self.lengths = np.concatenate((self.lengths, lengths.astype(np.int32)))
            self.ids = np.concatenate((self.ids, ids))

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[at]
        return gather(self.ids, self.starts[at], lengths), lengths


def runs(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``AT_A_TIME`` characters, a longer text on its own; short ones count as ten."""
    start = size = 0
    for i, text in enumerate(texts):
        if size + max(len(text), 10) > AT_A_TIME and i > start:
            yield texts[start:i]
            start, size = i, 0
        size += max(len(text), 10)
    if texts:
        yield texts[start:]


class Encoder:
    """Encodes batches of texts; remembers words, in two generations so that memory stays bounded."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = "|".join(re.escape(str(t.content)) for t in special)
        words = self.tokenizer.get_vocab()
        # a token is written with one character for each of its bytes
        self.bytes = np.zeros(max(words.values(), default=0) + 1, dtype=np.int64)
        self.bytes[list(words.values())] = [len(token) for token in words]
        self.young, self.old = Memory(), Memory()

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts; what the tokenizer returns takes a hundred bytes a token, so it goes run by run."""
        return [
            array("I", e.ids).tobytes()
            for run in runs(texts)
            for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)
        ]

    def _apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the rule cuts apart again: a space and something that is not white space."""
        edges = pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(edges, words), "").to_pylist()
        ids = np.frombuffer(b"".join(self._whole(texts) if texts else []), dtype="<u4")
        after = np.cumsum(np.asarray(pc.binary_length(words)), dtype=np.int64)
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), after) + 1, prepend=0)

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(words.to_pylist())
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype="<u4"), lengths

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words; those not met before are remembered."""
        if len(self.young.words) > REMEMBERED or self.young.words.nbytes > REMEMBERED_BYTES:
            self.young, self.old = Memory(), self.young
        young, old, marked = self.young, self.old, marks(words)
        at = young.find(words, marked)
        missing = np.flatnonzero(at < 0)
        before = old.find(words.take(pa.array(missing)), marked[missing])
        met, new = before >= 0, missing[before < 0]
        apart = np.asarray(pc.match_substring_regex(words.take(pa.array(new)), SPACED))
        for which, look_up in (
            (missing[met], lambda _: old.get(before[met])),
            (new[apart], self._apart),
            (new[~apart], self._alone),
        ):
            at[which] = len(young.words) + np.arange(len(which))
            part = words.take(pa.array(which))
            young.add(part, marked[which], *look_up(part))
        return young.get(at)

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the rule can cut into words."""
        out = []
        for run in runs(texts):
            words = [WORDS.findall(t) for t in run]
            encoded = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
            ids, ends = _each(encoded, *self._known(encoded.dictionary))
            ends = ends[np.cumsum([0, *map(len, words)])].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of consecutive texts: all ids in one array, and the number of ids of each text."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        chunk = np.cumsum(sizes) // CHUNK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(texts)] if len(texts) else []
        for a, b in zip(edges, edges[1:], strict=False):
            yield self._chunk(pc.fill_null(texts.slice(a, b - a), "").cast(pa.string()))
            pa.default_memory_pool().release_unused()  # else freed pages stay with the worker

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.asarray(pc.match_substring_regex(texts, UNKNOWN))
        if self.special:
            unknown |= np.asarray(pc.match_substring_regex(texts, self.special))
        uncertain = np.asarray(pc.match_substring_regex(texts, UNCERTAIN)) & ~unknown
        plain = ~(unknown | uncertain)
        counts = np.zeros(len(texts), dtype=np.int64)
        odd: dict[int, bytes] = {}
        for which, how in ((unknown, self._whole), (uncertain, self._cut)):
            at = np.flatnonzero(which)
            odd.update(zip(at.tolist(), how(texts.take(pa.array(at)).to_pylist()) if len(at) else [], strict=True))
        ids, lengths = self._plain(texts.filter(pa.array(plain)))
        counts[plain] = lengths
        if not odd:
            return ids, counts
        parts, start = [], 0
        for i in range(len(texts)):
            if i in odd:
                parts.append(np.frombuffer(odd[i], dtype="<u4"))
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[start : start + counts[i]])
                start += counts[i]
        return np.concatenate(parts), counts

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without white space in a row: a space begins a word, so the rule sees each piece between spaces once."""
        return self._parts(texts, pc.replace_substring(texts, " ", f"{MARK} "), self._words)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._parts(texts, pc.replace_substring_regex(texts, RE2_RULE, f"{MARK}\\0"), self._known)

    @staticmethod
    def _parts(texts: pa.Array, marked: pa.Array, look_up: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts from those of their parts between marks; every distinct part is looked up once."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        lists = pc.split_pattern(marked, MARK)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        del lists
        ids, ends = _each(encoded, *look_up(encoded.dictionary))
        offsets -= offsets[0]
        return ids, ends[offsets[1:]] - ends[offsets[:-1]]


def _each(encoded: pa.DictionaryArray, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order from those of the distinct ones, and where each word ends, 0 first."""
    which = np.asarray(encoded.indices)
    counts = length[which]
    ids = gather(flat, (np.cumsum(length) - length)[which], counts)
    return ids, np.concatenate(([0], np.cumsum(counts)))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + length]``, one after another."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One per worker process."""
    return Encoder(vocabulary)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(vocabulary: str, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text with the end id after them; NULL is an empty text."""
    for ids, counts in encoder(vocabulary).encode(texts):
        start = 0
        for n in counts.tolist():
            yield np.append(ids[start : start + n], np.uint32(end_id))
            start += n
