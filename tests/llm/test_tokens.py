"""Token files and packing: both against the tokenizer itself."""

import gc
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.edge import ROWS, edge, empty
from tokenizers import Tokenizer

from veilwright.llm import packing, queries, repair, tokens

VOCABULARY = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def test_words_and_whole_texts_agree(plain):
    draw = random.Random(1)
    letters = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "½", ".", "'s", "'", "!", "\xa0", "\x85", "\x1f", "ſ", "œ", "ɐ", "語", "\0"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(5000)] + [r[1] for r in ROWS]
    got = list(tokens.documents(VOCABULARY, pa.array(texts, pa.string()), 0))
    assert all(np.array_equal(a, plain(t)) for a, t in zip(got, texts, strict=True))


@pytest.mark.parametrize("ids", [[0], [5] * 40 + [0], [0] * 40, list(range(1, 60)) * 30 + [0]])
def test_grammar_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    rules, symbols = repair.compress(ids, 50_257)
    assert np.array_equal(repair.expand(symbols, rules, 50_257), ids) and len(symbols) <= len(ids)


def test_files_of_difficult_rows(spark, tmp_path, plain, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 50)
    path = str(tmp_path / "ids")
    repair.write(edge(spark), path, VOCABULARY, 50_257)
    got = repair.catalogue(spark, path).collect()
    want = sorted((r[0] is not None, r[0] or 0, crc(plain(r[1])), len(plain(r[1]))) for r in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r[0] if r[0] is not None else -1 for r in ROWS)
    # any document from its own symbols alone
    for shard in spark.read.parquet(path).collect():
        symbols = np.frombuffer(shard.symbols, dtype="<u2")
        rules = np.frombuffer(shard.rules, dtype="<u2").reshape(-1, 2)
        ends = np.cumsum(shard.n_symbols)
        for n, a, b in zip(shard.n_ids, ends - shard.n_symbols, ends, strict=True):
            ids = repair.expand(symbols[a:b], rules, shard.base)
            assert len(ids) == n and ids[-1] == 0
    assert repair.read(spark, path).count() == len(ROWS)


def test_token_file_query(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op7_repair_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for doc_id, text in docs:
        ids = plain(text)
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_no_documents_no_files(spark, tmp_path):
    repair.write(empty(spark), str(tmp_path / "none"), VOCABULARY, 50_257)
    assert repair.catalogue(spark, str(tmp_path / "none")).count() == 0


def check_packing(got, docs, plain, capacity):
    """Every document's pieces in order, every sequence gapless; returns the number of sequences."""
    want = sorted(
        (crc(ids[a:b]), b - a, a)
        for _, text in docs
        for ids in [plain(text)]
        for head in [len(ids) % capacity or capacity]
        for a, b in zip([0, *range(head, len(ids), capacity)], [*range(head, len(ids) + 1, capacity)], strict=True)
    )
    assert sorted((r.ids_crc32, r.length, r.start) for r in got.itertuples()) == want
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.cumsum(part.length) - part.length).all() and part.length.sum() <= capacity
    return got.sequence_id.nunique()


@pytest.mark.parametrize("group", [50_000, 40])
def test_packing_query(spark, plain, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_ITEMS", group)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op8_sum_of_squares_packing(spark, "/root/testdata/sf0.001").toPandas()
    count = check_packing(got, docs, plain, 2048)
    assert count <= 1.06 * -(-got.length.sum() // 2048)


def test_packing_of_difficult_rows(spark, plain):
    got = packing.pack(edge(spark), VOCABULARY, 64).toPandas()
    check_packing(got, [(r[0], r[1]) for r in ROWS], plain, 64)
    assert packing.pack(empty(spark), VOCABULARY, 64).count() == 0


def test_squares_decide_the_place():
    # gap 3 is open once, gap 4 three times: an item of 1 makes a gap of 4 a gap of 3
    sequence, offset = packing.place(np.array([7, 6, 6, 6, 1]), 10)
    assert offset.tolist() == [0, 0, 0, 0, 6] and len(set(sequence)) == 4
    # with 3 and 4 open once and twice both places are as good: the smaller gap is taken
    assert packing.place(np.array([7, 6, 6, 5, 1]), 10)[1][4] == 7


@pytest.mark.parametrize("ids", [[5] * 9999, [1, 2, 3] * 4000, [7, 7, 8] * 3000 + [0] + [7] * 501, list(range(1, 300)) * 40])
def test_no_frequent_pair_is_left(ids):
    ids = np.array(ids, dtype=np.uint32)
    rules, symbols = repair.compress(ids, 50_257)
    assert (repair.expand(symbols, rules, 50_257) == ids).all()
    assert (repair.lengths_of(rules, 50_257)[symbols]).sum() == len(ids)
    pairs, counts = np.unique(symbols[:-1].astype(np.int64) * 65_536 + symbols[1:], return_counts=True)
    inner = (pairs // 65_536 != repair.END_ID) & (pairs % 65_536 != repair.END_ID)
    assert not len(counts[inner]) or counts[inner].max() < repair.FREQUENT


def test_winners_never_overlap():
    draw = np.random.default_rng(5)
    for _ in range(200):
        at = np.flatnonzero(draw.random(60) < 0.7)
        rank = draw.integers(0, 4, len(at))
        won = repair._winners(at, rank)
        assert (np.diff(at[won]) > 1).all()
        if len(at):
            top = np.flatnonzero(rank == rank.max())
            assert len(np.intersect1d(won, top)) * 2 >= len(top)


def test_new_words_go_through_the_tokenizer_together(plain, monkeypatch):
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefgé") for _ in range(9)) for _ in range(6000)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]
    sent = []
    whole = tokens.Encoder._whole
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, t: sent.append(len(t)) or whole(self, t))
    (ids, counts), = tokens.Encoder(VOCABULARY).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert [*ids[a:b], 0] == plain(text).tolist()
    # one by one only the first word of each text and what stands before it
    assert sum(sent) <= len(texts) + 1 + -(-len(words) // tokens.TOGETHER)


def test_remembered_words_take_a_few_bytes(plain):
    draw = random.Random(13)
    texts = [" ".join("".join(draw.choice("abcdefgé") for _ in range(9)) for _ in range(60)) for _ in range(500)]
    encoder = tokens.Encoder(VOCABULARY)
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    got = [ids[a:b] for ids, n in encoder.encode(pa.array(texts)) for a, b in zip(np.cumsum(n) - n, np.cumsum(n), strict=True)]
    assert all([*ids, 0] == plain(t).tolist() for ids, t in zip(got, texts, strict=True))
    del got
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 75 * 30_000


@pytest.mark.parametrize("text", ["語の文 ", "two  spaces ", "aa\t\tbb "])
def test_the_tokenizer_gets_bounded_runs(plain, monkeypatch, text):
    monkeypatch.setattr(tokens, "AT_A_TIME", 2000)
    encoder, sent = tokens.Encoder(VOCABULARY), []
    inner = encoder.tokenizer

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sent.append(sum(map(len, texts)))
            return inner.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    texts = [text * i + str(i) for i in range(60)] * 4 + [text * 900]
    (ids, counts), = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert all([*ids[a:b], 0] == plain(t).tolist() for t, a, b in zip(texts, ends - counts, ends, strict=True))
    assert max(sent) <= max(2000, len(text) * 900) and (sum(sent) < sum(map(len, texts)) or len(sent) > 10)


def test_words_are_found_after_they_have_grown_old(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 40)
    texts = ["one two three four", "five six  seven", "", "one two\n\nsix é", "eight nine ten", "two four ten five one"] * 3
    got = list(tokens.documents(VOCABULARY, pa.array(texts), 0))
    assert all(np.array_equal(a, plain(t)) for a, t in zip(got, texts, strict=True))


def test_late_passes_look_at_few_places(monkeypatch):
    draw = np.random.default_rng(11)
    ids = np.minimum(draw.zipf(1.5, 200_000), 3000).astype(np.uint32)
    looked_at = []
    among = repair._among
    monkeypatch.setattr(repair, "_among", lambda pairs, key: looked_at.append(len(key)) or among(pairs, key))
    rules, symbols = repair.compress(ids, 50_257)
    assert (repair.expand(symbols, rules, 50_257) == ids).all()
    assert len(looked_at) > 4 and looked_at[-1] < len(symbols) / 5


@pytest.mark.parametrize("room", [400, 2000])
def test_late_passes_look_at_few_places_where_symbols_run_out(monkeypatch, room):
    draw = np.random.default_rng(12)
    ids = np.minimum(draw.zipf(1.3, 200_000), 3000).astype(np.uint32)
    looked_at = []
    among = repair._among
    monkeypatch.setattr(repair, "_among", lambda pairs, key: looked_at.append(len(key)) or among(pairs, key))
    base = repair.SYMBOLS - room
    rules, symbols = repair.compress(ids, base)
    assert (repair.expand(symbols, rules, base) == ids).all() and len(rules) == room
    assert looked_at[-1] < 0.5 * len(symbols)


def test_counts_of_values():
    draw = np.random.default_rng(4)
    for size in (0, 1, 2, 500):
        values = draw.integers(0, 40, size).astype(np.uint32)
        got, want = repair._counted(values), np.unique(values, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_remembered_words_are_found_by_marks():
    draw = random.Random(21)
    known = list({"".join(draw.choices("abé語 ", k=draw.choice([0, 1, 5, 9, 70, 200]))) for _ in range(40_000)})
    assert len(set(tokens.marks(pa.array(known)).tolist())) == len(known) > tokens.MARKED
    assert not len(tokens.marks(pa.array([], pa.string())))
    memory, held = tokens.Memory(), {}
    for start in range(0, len(known) // 2, 3000):
        part = pa.array(["", *known], pa.string()).slice(start + 1, 3000)
        memory.add(part, tokens.marks(part), np.arange(3000, dtype="<u4"), np.ones(3000, dtype=np.int64))
        held |= {w: start + i for i, w in enumerate(part.to_pylist())}
    got = memory.find(pa.array(known), tokens.marks(pa.array(known)))
    assert got.tolist() == [held.get(w, -1) for w in known] and -1 in got


def test_words_of_one_mark_keep_their_ids(plain, monkeypatch):
    monkeypatch.setattr(tokens, "marks", lambda words: np.asarray(tokens.pc.binary_length(words)).astype(np.uint64))
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 40)
    texts = ["one two six ten", "ten two nine eight", "", "two  one\n\nsix é", "eight nine ten", "the for and you one"] * 3
    got = list(tokens.documents(VOCABULARY, pa.array(texts), 0))
    assert all(np.array_equal(a, plain(t)) for a, t in zip(got, texts, strict=True))
