import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from edge import edge, empty

from veilwright.llm import pieces, queries

TEXTS = [
    "a", "▁ a", "  a  b ", "日本語 🙂 x", "naïve\0 x", " ", "   ", "\n\n a\t", "a▁▁b ▁", "ab" * 5000, "<s> </s> <unk> <0x41>",
    "éé́ ﻿", "tail ", "x" + " " * 40 + "y", "é​ ﬁ",
]


def spans(text):
    """Ids and source bytes of the pieces, as the library has them."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("together", [True, False])
def test_pieces_are_those_of_the_library(together):
    own = pieces.Pieces(pieces.model_path())
    assert own.plain
    own.plain = together
    ids, starts, ends, counts = own.encode(pa.array(TEXTS))
    got, at = list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)), 0
    for text, count in zip(TEXTS, counts.tolist(), strict=True):
        assert got[at : at + count] == spans(text)
        at += count


def test_texts_that_meet_the_map_beside_others():
    """The map of another normaliser: all texts give the records that they give one by one."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False)
    own = pieces.Pieces(pieces.model_path())
    own.normalizer = pieces.Normalizer(dict(pieces.fields(library.serialized_model_proto()))[pieces.NORMALIZER])
    texts = ["- --", "ﬁne ①", "日本", "a  b ", "plain text", "12"]
    own.mapped[sorted(own.normalizer.map.first)] = True
    assert not own.mapped[ord("-")] and own.mapped["①".encode()[0]]
    origin, base = own._normalised(pa.array(texts))
    want = [own.normalizer.apply(t)[1] for t in texts]
    assert origin.tolist() == [x for w in want for x in w] and np.diff(base).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [{}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False, "escape_whitespaces": False}])
def test_normalised_text_and_its_sources(rule, flags):
    """The library gives offsets in characters."""
    flags = {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": False} | flags
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    own = pieces.Normalizer(dict(pieces.fields(library.serialized_model_proto()))[pieces.NORMALIZER])
    assert (own.prefix, own.escape, own.squeeze) == tuple(
        flags[n] for n in ("add_dummy_prefix", "escape_whitespaces", "remove_extra_whitespaces")
    )
    pool = ["a", " ", "  ", "ｱ", "ﬁ", "①", "é", "é", "▁", "日", "🙂", "　", "ガ", "ｶﾞ", "Å", "\t", "\n", "​", "\0", "İ", "ß", "㍿"]
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choice(pool) for _ in range(draw.randrange(12)))
        want, origin = library.normalize(text, with_offsets=True)
        got, places = own.apply(text)
        assert got.decode() == want
        byte = [len(want[:i].encode()) for i in range(len(want) + 1)]
        if want:  # the end of nothing is anywhere
            assert [len(text.encode()[: places[b]].decode()) for b in byte] == list(origin)


def digests(text):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids = library.encode(text or "")
    named = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return len(ids), named, hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((text or "").encode())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_the_library(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_offset_preserving_pieces(spark, f"/root/testdata/sf{sf}").collect()
    want = sorted((r.doc_id, *digests(r.text)) for r in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes) for r in got) == want


def test_edges(spark):
    encoded = pieces.encode(edge(spark), pieces.model_path())
    got = pieces.decode(encoded, pieces.model_path()).collect()
    want = [(r.doc_id, spans(r.text or ""), (r.text or "").lstrip("﻿")) for r in edge(spark).collect()]
    have = [(r.doc_id, list(zip(r.ids, r.starts, r.ends, strict=True)), r.decoded) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    nothing = pieces.decode(pieces.encode(empty(spark), pieces.model_path()), pieces.model_path())
    assert nothing.count() == 0
    with pytest.raises(ValueError, match="already"):
        pieces.decode(encoded, pieces.model_path(), name="IDS")


def test_columns_that_clash(spark):
    df = spark.createDataFrame([("x y", "k", [1])], "ids string, text string, `Text 2` array<int>")
    (row,) = pieces.encode(df, pieces.model_path(), key="text", text="ids").collect()
    assert row.text == "k" and [(a, b) for a, b in zip(row.starts, row.ends, strict=True)] == [(0, 1), (1, 3)]
