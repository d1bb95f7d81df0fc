import re

from pyspark.sql import functions as F
from tests.llm.edge import edge, empty

from veilwright.llm import mixing, queries


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Share by weight; what exceeds a limit is shared anew until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


def check(rows, got, slack):
    sizes = {}
    for source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    for source, size in sizes.items():
        part = got[got.source.isna()] if source is None else got[got.source == source]
        assert part.source_size.eq(size).all() and part["size"].sum() == size
        assert abs(part.target.iloc[0] - want[source]) < 1e-6 * max(1, want[source])
        assert (part.taken <= 3 * part["size"]).all()
        assert abs(part.taken.sum() - want[source]) <= slack * part["size"].max()


def test_query_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("source", "text").collect()
    got = queries.op6_hash_threshold_mix(spark, "/root/testdata/sf0.01").toPandas()
    again = queries.op6_hash_threshold_mix(spark, "/root/testdata/sf0.01").toPandas()
    check([tuple(r) for r in docs], got, 0.5)
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())


def test_difficult_rows_and_many_copies(spark):
    copies = spark.range(300).select(F.lit(50).cast("bigint").alias("doc_id"), F.lit("five words in each copy").alias("text"), F.lit("b").alias("source"))
    rows = edge(spark).select("doc_id", "text", "source").unionByName(copies)
    got = mixing.mix(rows).toPandas()
    assert len(got) == rows.count()
    check([(r.source, r.text) for r in rows.collect()], got, 0.5)
    assert mixing.mix(empty(spark)).count() == 0


def test_the_mix_on_rows(spark):
    df = edge(spark)
    taken, times = mixing.apply_mix(df), mixing.mix(df)
    assert taken.columns == df.columns
    assert taken.count() == times.agg(F.sum("times")).first()[0]
    assert mixing.apply_mix(empty(spark)).count() == 0
