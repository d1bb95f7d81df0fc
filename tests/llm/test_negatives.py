import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright.llm import negatives, queries


def brute(rows, anchor, positives=5, top=3):
    """Rows of the result from the definition, in whole numbers of Python; rows are (id, label, vector)."""
    kept = [(i, c, [int(np.floor(256 * float(x))) for x in v]) for i, c, v in rows if c is not None and usable(v)]
    out = []
    late = lambda i: (i is None, i or 0)
    for k, (own, label, vector) in enumerate(kept):
        if not anchor(own):
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v, strict=True)), late(i), i, c) for n, (i, c, v) in enumerate(kept) if n != k]
        scored.sort(key=lambda s: s[:2])
        for p in [s for s in scored if s[3] == label][:positives]:
            hard = [s for s in scored if s[3] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:top]
            out += [(own, p[2], rank, s[2], -p[0], -s[0]) for rank, s in enumerate(hard, 1)]
    return out


def usable(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


def same(got, want):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_query_against_brute_force(spark, monkeypatch, small):
    if small:  # several groups of anchors and many cells and runs
        for name, value in {"GROUP": 3, "CELL": 40, "RUN": 4, "CHUNK": 16}.items():
            monkeypatch.setattr(negatives, name, value)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table]
    got = queries.op11_angular_hard_negatives(spark, "/root/testdata/sf0.01").collect()
    assert got
    same(got, brute(rows, lambda i: i % 50 == 0))


def test_difficult_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in draw.normal(size=3)]) for i in range(120)]
    rows += [(200 + i, 1, [1.0, 0.5, 0.0]) for i in range(40)] + [(250, 1, [1.0, 0.5, 0.0])] * 3 + [(300, 2, [0.8, 0.4, 0.0])] * 3
    rows += [(350, 0, [0.0, 0.0, 0.0]), (400, None, [1.0, 1.0, 1.0]), (450, 1, None), (500, 1, [1.0, None, 0.0])]
    rows += [(550, 1, [float("nan"), 0.0, 0.0]), (600, 1, [float("inf"), 0.0, 0.0]), (None, 1, [1.0, 0.5, 0.0]), (None, 2, [0.8, 0.4, 0.1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, place string")
    got = negatives.mine(df, F.col("vec_id") % 50 == 0).collect()
    same(got, brute(rows, lambda i: i is not None and i % 50 == 0))


def test_large_scores_stay_exact(spark):
    rows = [(i, i % 2, [2.0**21 + i, 2.0**20 - i * i, 3.0 * i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, low=0, high=100).collect()
    kept = {(r.anchor_id, r.positive_id): r.positive_score for r in got}
    whole = {i: [int(256 * x) for x in v] for i, _, v in rows}
    assert kept and all(s == sum(a * b for a, b in zip(whole[i], whole[j], strict=True)) for (i, j), s in kept.items())


@pytest.mark.parametrize("rows", [[], [(50, 1, [1.0])], [(50, None, [1.0, 2.0])], [(50, 1, [])]])
def test_too_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert negatives.mine(df, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    """No score lies outside its bounds, also for vectors alike but for the last digit and for opposite ones."""
    draw = np.random.default_rng(7)
    a = draw.integers(-200, 200, (300, 8)).astype(float)
    a[100:200], a[200:] = a[:100] * 3, -a[:100]
    refs = a[:8] / np.linalg.norm(a[:8], axis=1)[:, None]
    norm = np.linalg.norm(a, axis=1)
    angles = np.arccos(np.clip(a @ refs.T / norm[:, None], -1, 1)).astype(np.float32).astype(float)
    low, high = negatives.score_bounds(norm, angles, (norm, norm), (angles, angles))
    scores = a @ a.T
    assert (low <= scores).all() and (scores <= high).all() and (high - low < np.outer(norm, norm)).any()


def test_runs_out_of_reach_are_not_scored(monkeypatch):
    """Far clusters: an anchor of one asks for nothing of the others."""
    draw = np.random.default_rng(9)
    centre = np.eye(8)[np.repeat(np.arange(8), 256)] * 4000
    vectors = np.floor(centre + draw.normal(size=centre.shape) * 20)
    norm = np.linalg.norm(vectors, axis=1)
    angles = np.arccos(np.clip(vectors @ np.eye(8) / norm[:, None], -1, 1))
    starts = np.arange(0, len(vectors), 256)
    windows = np.minimum.reduceat(angles, starts), np.maximum.reduceat(angles, starts)
    norms = np.minimum.reduceat(norm, starts), np.maximum.reduceat(norm, starts)
    _, high = negatives.score_bounds(norm[:5], angles[:5], norms, windows)
    assert (high[:, 0] > 1.5e7).all() and (high[:, 1:] < 1e6).all()
