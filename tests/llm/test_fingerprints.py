import difflib
import hashlib

import numpy as np
from tests.llm.edge import edge, empty

from veilwright.llm import fingerprints as fp
from veilwright.llm import queries


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "CELL_BITS", 4)  # many cells
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op9_edit_embedding_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    texts = [r.text for r in docs]
    prints = fp.written(*fp.walk(texts))
    assert len(got) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        following, gone = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - gone] + following[:gone]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == prints[i] and row.edited_fingerprint == fp.written(*fp.walk([edited]))[0]
    near, apart = [r.near_edited for r in got.values()], [r.near_next for r in got.values()]
    assert min(near) > 0.5 and np.mean(near) > 0.7 and np.mean(apart) < 0.05


def test_difficult_rows(spark):
    got = fp.compare_with_edits(edge(spark)).collect()
    assert len(got) == 13
    by_text = {}
    for r in got:
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(by_text[0]) == 1 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert fp.compare_with_edits(empty(spark)).count() == 0
    assert fp.compare_with_edits(edge(spark).filter("doc_id = 0")).first().near_next == 1.0


def test_small_edits_stay_near():
    base = "".join(chr(97 + i * i % 23) + " " * (i % 5 == 0) for i in range(3000))
    edited = base[:1000] + "x" + base[1000:2000] + base[2003:]
    level, samples = fp.walk([base, edited, base[::-1], ""])
    likeness = fp.likeness(level[[0, 0, 0, 3]], samples[[0, 0, 0, 3]], level[[1, 2, 3, 3]], samples[[1, 2, 3, 3]])
    assert likeness[0] > 0.6 and likeness[1] < 0.2 and likeness[2] == 0 and likeness[3] == 1


def test_fingerprints_alone(spark):
    got = fp.fingerprints(edge(spark)).toPandas()
    assert got.columns.tolist() == ["doc_id", "fingerprint"] and len(got) == 13
    level, samples = fp.parsed(got.fingerprint.tolist())
    assert fp.written(level, samples) == got.fingerprint.tolist()


def test_groups_of_alike_texts(spark):
    base = ["".join(chr(97 + (i * i * k + i // 3) % 23) + " " * (i % 5 == 0) for i in range(1500)) for k in (1, 5, 7)]
    texts = [b[:cut] + "zq" + b[cut + 2 :] for b in base for cut in (300, 700, 1400)] + ["", "", "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.group_id for r in fp.near_groups(rows, 0.5).collect()}
    assert got == {i: i // 3 * 3 for i in range(9)} | {9: 9, 10: 9, 11: 11}
    assert fp.near_groups(edge(spark)).count() == 13 and fp.near_groups(empty(spark)).count() == 0


def test_recall_of_planted_pairs(spark):
    """Texts of 240 characters from the documents, and each again with one character replaced, lost or added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()
    rng = np.random.default_rng(3)
    plain = sorted({r.text[-240:] for r in docs if r.text and len(r.text) > 800})[:200]
    rows = []
    for i, text in enumerate(plain):
        at, kind = int(rng.integers(0, len(text))), i % 3
        rows += [(2 * i, text), (2 * i + 1, text[:at] + "~" * (kind != 1) + text[at + (kind != 2) :])]
    got = {r.doc_id: r.group_id for r in fp.near_groups(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert len(got) == 2 * len(plain)
    together = np.mean([got[2 * i] == got[2 * i + 1] for i in range(len(plain))])
    assert together >= 0.9
    members = {}
    for doc_id, group in got.items():
        members.setdefault(group, set()).add(doc_id // 2)
    for group in members.values():  # the documents hold near copies of their own; nothing else may be put together
        first, *others = sorted(group)
        assert all(difflib.SequenceMatcher(None, plain[first], plain[o], False).ratio() > 0.9 for o in others)
