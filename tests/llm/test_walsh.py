import hashlib

import numpy as np
import pytest

from veilwright.llm import queries, walsh


def brute(rows, clusters=16, rounds=3, scale=64, dimension=64):
    """(id, cluster, distance) in whole numbers of Python, from the definition."""
    kept = []
    for number, vector in rows:
        if vector is None or len(vector) != dimension or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((number, [int(np.floor(scale * float(x))) for x in vector]))
    named = [(hashlib.sha256(f"1:{n}".encode()).hexdigest(), v) for n, v in kept if n is not None]
    centroids = [v for _, v in sorted(named)[:clusters]]

    def place(vector):
        return min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        found = [place(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, found, strict=True) if c == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(n, *reversed(place(v))) for n, v in kept] if centroids else []


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)


def test_query_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    got = queries.op12_walsh_hadamard_clusters(spark, "/root/testdata/sf0.01").collect()
    same(got, brute([(r.vec_id, r.embedding) for r in table]))
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for c in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == c} == {sum(r.distance for r in got if r.cluster == c)}


def test_difficult_vectors(spark):
    rows = [(i, [float(i % 3), 0.5, -1.0, i / 7]) for i in range(40)] + [(5, [9.0, 9.0, 9.0, 9.0])] * 30
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (50, None), (51, []), (52, [1.0, None, 0.0, 0.0]), (53, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(54, [float("-inf"), 1.0, 1.0, 1.0]), (55, [1.0] * 5), (56, [0.0] * 4)]
    df = spark.createDataFrame([(n, v, 1) for n, v in rows], "vec_id bigint, embedding array<double>, cluster int")
    same(walsh.cluster(df, clusters=6, dimension=4).collect(), brute(rows, clusters=6, dimension=4))


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**27 + i, -(2.0**26), float(i), 3.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    same(walsh.cluster(df, clusters=4, dimension=4).collect(), brute(rows, clusters=4, dimension=4))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0, 2.0])]])
def test_no_centroid(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert walsh.cluster(df, dimension=2).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        walsh.cluster(df, dimension=3)


def test_transform_keeps_distances():
    draw = np.random.default_rng(2)
    a, b = draw.integers(-90, 90, (2, 500, 64))
    assert ((a - b) ** 2).sum(axis=1).tolist() == (((walsh.transform(a) - walsh.transform(b)) ** 2).sum(axis=1) // 64).tolist()
    number, distance = walsh.nearest(walsh.transform(a), walsh.transform(b[:16]))
    every = ((a[:, None] - b[None, :16]) ** 2).sum(axis=2)
    assert number.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
