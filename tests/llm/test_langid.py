import math

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.edge import edge, empty

from veilwright.llm import langid, queries


@pytest.fixture(scope="module")
def net(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    got = queries.op2_byte_convolution_langid(spark, "/root/testdata/sf0.01").toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(docs) and (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_difficult_rows_keep_their_columns(spark, net):
    got = langid.identify(edge(spark), net)
    assert got.columns == edge(spark).columns + ["lang_pred", "score"]
    table = got.toPandas()
    unknown = table[table.lang_pred == langid.UNKNOWN]
    assert len(table) == 13 and set(unknown.text.dropna()) == {"", "12345 !!! --- 678"}
    assert (unknown.score == 0).all() and table.text.isna().sum() == 2


def test_nothing_to_learn_from(spark):
    assert langid.fit(empty(spark)) is None
    assert {r.lang_pred for r in langid.identify(edge(spark), None).collect()} == {langid.UNKNOWN}
    assert langid.identify(empty(spark), None).count() == 0


def test_every_byte_counts(net):
    # the windows of a text hold all of its bytes and nothing of its neighbours
    import numpy as np

    data = np.frombuffer(b"ab" * 500 + b"z" * 3, dtype=np.uint8)
    windows, text, size = langid.cut(data, np.array([0, 1000]), np.array([1000, 1003]))
    assert set(text) == {0, 1} and (windows[text == 1] != 0).sum() == 3
    covered = 0
    for window, n in zip(windows[text == 0], size[text == 0], strict=True):
        assert bytes(window[:n]) in b"ab" * 500
        covered += n
    assert covered - langid.OVERLAP * ((text == 0).sum() - 1) == 1000
    assert langid.classify(net, pa.array(["the and of"]))[1][0] > 0


def naive(net, text):
    """The likeliest language and its probability, filter by filter and place by place."""
    raw, logs, weight = text.encode(), np.zeros(len(net.languages)), 0
    stride = langid.WINDOW - (max(langid.WIDTHS) - 1)
    start = 0
    while True:
        part = raw[start : start + langid.WINDOW]
        window = part.ljust(langid.WINDOW, b"\0")
        pooled = []
        for table, bias in zip(net.tables, net.biases, strict=True):
            width = len(table)
            seen = [sum(table[i, window[at + i]].astype(float) for i in range(width)) for at in range(len(window) - width + 1)]
            pooled += [max(0.0, max(s[f] for s in seen) + float(bias[f])) for f in range(table.shape[2])]
        scores = [sum(p * float(w) for p, w in zip(pooled, column, strict=True)) + float(o) for column, o in zip(net.weights.T, net.offset, strict=True)]
        shift = max(scores)
        total = shift + math.log(sum(math.exp(s - shift) for s in scores))
        logs += (np.array(scores) - total) * len(part)
        weight += len(part)
        start += stride
        if start + max(langid.WIDTHS) - 1 >= len(raw):
            break
    mean = logs / weight
    share = np.exp(mean - mean.max())
    share /= share.sum()
    return int(share.argmax()), float(share.max())


def test_network_by_brute_force():
    draw = np.random.default_rng(11)
    net = langid.Network(
        ["a", "b", "c"],
        [draw.normal(0, 1, (w, 256, 3)).astype(np.float32) for w in langid.WIDTHS],
        [draw.normal(0, 1, 3).astype(np.float32) for _ in langid.WIDTHS],
        draw.normal(0, 0.2, (3 * len(langid.WIDTHS), 3)).astype(np.float32),
        draw.normal(0, 0.2, 3).astype(np.float32),
    )
    texts = ["x", "naïve café 日本", "".join(draw.choice(list("abc dé"), 700)), "".join(draw.choice(list("xyz w"), langid.WINDOW))]
    best, score = langid.classify(net, pa.array(texts))
    for i, text in enumerate(texts):
        want, probability = naive(net, text)
        assert best[i] == want and score[i] == pytest.approx(probability, rel=1e-3)
