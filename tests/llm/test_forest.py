import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright.llm import forest, queries


def brute(ids, vectors, query, top=20):
    scores = vectors @ vectors[query]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]][:top]
    return [(ids[i], scores[i]) for i in order]


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = queries.op10_projection_forest_search(spark, "/root/testdata/sf0.1").toPandas()
    found = 0
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    for i in asked:
        part = got[got.query_id == ids[i]].sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and ids[i] not in set(part.vec_id)
        assert np.allclose(part.score, vectors[np.searchsorted(ids, part.vec_id)] @ vectors[i], atol=1e-12)
        found += len({v for v, _ in brute(ids, vectors, i)} & set(part.vec_id))
    assert got.query_id.nunique() == len(asked) and found / (20 * len(asked)) >= 0.9


def test_difficult_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    rows += [(60, None), (80, [0.0, 0.0, 0.0]), (100, [float("nan"), 1.0, 0.0]), (120, [1.0, None, 0.0]), (140, [1.0, 2.0])]
    rows += [(160, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])] + [(1000 + i, [2.0, 2.0, 2.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("number", F.lit("x"))
    got = forest.nearest(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    good = [(i, v) for i, v in rows if i is not None and (i < 60 or i >= 1000)]
    ids, vectors = np.array([i for i, _ in good]), np.array([v for _, v in good])
    assert sorted(set(got.query_id)) == [i for i in ids if i % 20 == 0]
    for k, i in enumerate(ids):
        if i % 20 == 0:
            part = got[got.query_id == i].sort_values("rank")
            assert [(a, round(b, 9)) for a, b in zip(part.vec_id, part.score, strict=True)] == [(a, round(b, 9)) for a, b in brute(ids, vectors, k)]


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(20, None)]])
def test_too_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert forest.nearest(df, F.col("vec_id") % 20 == 0).count() == 0


def test_trees_hold_every_vector_once():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(900, 8))
    tree = forest.grow(vectors, 32, draw)
    leaf = tree.leaf_of(vectors)
    assert np.bincount(leaf, minlength=tree.leaves).max() <= 32 and leaf.max() < tree.leaves
    every = forest.search([tree], vectors[3], tree.leaves)
    assert len(set(every)) == tree.leaves and every[0] == (0, leaf[3])
    same = forest.grow(np.ones((500, 8)), 32, draw)
    assert same.leaves == 1 and not same.leaf_of(np.ones((3, 8))).any()
