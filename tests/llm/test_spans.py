import random

import pytest
from tests.llm.edge import edge, empty

from veilwright.llm import queries, spans

PASSAGE = "First the rain came down on us. Then it was the turn of snow. At last the sun came out again. "


def brute(docs):
    first, out = {}, {}
    for doc_id, text in sorted(docs):
        at, hashes = spans.spans(text)
        gone = []
        for place, span in zip(at, hashes, strict=True):
            if span in first:
                gone.append(place)
            first.setdefault(span, (doc_id, place))
        out[doc_id] = spans.cut_out(text, gone)
    return out


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in docs])
    got = queries.op3_sentence_span_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert all(want[r.doc_id] == (r.text, r.removed, r.sentences) for r in got)


def test_a_passage_survives_in_the_first_document_only(spark):
    texts = [(5, "Here it begins. " + PASSAGE + "And ends."), (3, "Other start. " + PASSAGE + "Other end."), (9, PASSAGE + PASSAGE)]
    got = {r.doc_id: r.text for r in spans.remove_repeats(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == {3: texts[1][1], 5: "Here it begins. And ends.", 9: ""}


def test_difficult_rows(spark):
    got = spans.remove_repeats(edge(spark))
    assert got.columns == edge(spark).columns + ["removed", "sentences"]
    table = got.toPandas()
    assert len(table) == 13 and table.text.isna().sum() == 2
    kept = table.set_index("doc_id").text
    assert "quick brown" in kept[0] and kept[1] == ""
    assert kept[6].count("Lorem") <= spans.SPAN + 1
    assert (kept[7].str.len() > 0).all()
    assert spans.remove_repeats(empty(spark)).count() == 0


def test_sentences_make_up_the_text():
    for text in ("", "...", "A 3.14 b. C\n\nd", "x.\n y.  z", "no end"):
        assert "".join(spans.sentences(text)) == text


def words_of(draw, n):
    return ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


@pytest.mark.parametrize("words", [50, 25, 13, 2, 1])
def test_fifty_words_survive_once_however_they_are_punctuated(spark, words):
    draw = random.Random(words)
    rows, passages = [], []
    for i in range(40):
        passage = [w + "." * (k % words == words - 1) for k, w in enumerate(words_of(draw, 50))]
        passages.append(passage)
        # in mid-sentence at both ends, too
        rows += [(2 * i + k, " ".join(words_of(draw, draw.randint(0, 30)) + passage + words_of(draw, draw.randint(0, 30)))) for k in (0, 1)]
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, passage in enumerate(passages):
        assert got[2 * i].text == rows[2 * i][1]
        left, own = got[2 * i + 1].text.split(), rows[2 * i + 1][1].split()
        assert len(set(passage) & set(left)) <= 2 * (spans.WINDOW - 1)
        assert [w for w in own if w not in passage] == [w for w in left if w not in passage]


def test_fifty_words_in_one_long_text_without_full_stops():
    draw = random.Random(5)
    passage = words_of(draw, 50)
    found = [set(spans.spans(" ".join(words_of(draw, n) + passage + words_of(draw, n)))[1]) for n in range(0, 200, 3)]
    assert all(a & b for a in found for b in found)
    assert not set(spans.spans(" ".join(words_of(draw, 5000)))[1]) & found[0]


def test_whole_sentences_are_cut_out_to_the_last_word():
    draw = random.Random(6)
    for each in (50, 25, 2, 1):
        passage = " ".join(w + "." * (k % each == each - 1) for k, w in enumerate(words_of(draw, 50))) + " "
        known = set(spans.spans(passage)[1])
        text = "Before it. " + passage + "And after.\n"
        gone = [place for place, span in zip(*spans.spans(text), strict=True) if span in known]
        assert spans.cut_out(text, gone) == ("Before it. And after.\n", 50 // each, 50 // each + 2)
