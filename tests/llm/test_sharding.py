import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from tests.llm.edge import edge, empty

from veilwright.llm import queries, sharding


def test_growth_moves_rows_only_into_the_new_shard(spark):
    got = sharding.shard(spark.range(20_000), ["id"], [1.0] * 8).toPandas()
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) == {8} and 0.09 < len(moved) / len(got) < 0.13
    assert got.groupby("shard").size().between(2300, 2700).all()


def test_weights_set_the_shares(spark):
    sizes = sharding.shard(spark.range(20_000), ["id"], [1.0, 3.0]).groupBy("shard").count().toPandas()
    assert 0.73 < sizes["count"][sizes["shard"] == 1].iloc[0] / 20_000 < 0.77


def drawn(key, weights):
    """The shard of a record, computed without Spark: a long and a text hashed one after the other."""
    start = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
    draws = []
    for i, weight in enumerate(weights):
        bits = xxhash.xxh64_intdigest(f"shard {i}".encode(), start) >> 11
        draws.append((-math.log((bits + 0.5) / 2.0**53) / weight, i))
    return min(draws)[1]


def test_shards_by_brute_force(spark):
    keys = [*range(-500, 500), 2**40, None]
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id bigint")
    for weights in ([1.0] * 8, [1.0, 2.5, 0.5]):
        got = sharding.shard(rows, ["doc_id"], weights, added=2.0).collect()
        assert all((r["shard"], r.grown_shard) == (drawn(r.doc_id, weights), drawn(r.doc_id, [*weights, 2.0])) for r in got)


def test_a_key_of_another_whole_type_goes_to_the_same_shard(spark):
    long = {r.id: r["shard"] for r in sharding.shard(spark.range(100), ["id"], [1.0] * 8).collect()}
    short = sharding.shard(spark.range(100).select(F.col("id").cast("int")), ["id"], [1.0] * 8).collect()
    assert {r.id: r["shard"] for r in short} == long


def test_clashing_names(spark):
    names = ["shard", "copies", "cell", "group", "of", "offset", "before", "copy", "block", "total", "__copies", "own_0"]
    rows = spark.range(50).select(*[(F.col("id") % (i + 2)).alias(n) for i, n in enumerate(names)])
    got = sharding.number_within(rows, "shard", "slot").collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(map(tuple, rows.collect()))
    for shard in (0, 1):
        assert sorted(r.slot for r in got if r["shard"] == shard) == list(range(25))


def test_slots_are_gapless_over_copies_and_nulls(spark):
    rows = edge(spark).select("doc_id", "source").unionByName(spark.range(70_000).select(F.lit(9).alias("doc_id"), F.lit("q").alias("source")))
    placed = sharding.number_within(sharding.shard(rows, ["doc_id"], [1.0] * 3).drop("grown_shard"), "shard", "slot")
    got = placed.toPandas()
    assert len(got) == rows.count()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    before = Counter(map(tuple, rows.collect()))
    assert Counter((r.doc_id, r.source) for r in placed.collect()) == before


def test_an_empty_table(spark):
    rows = empty(spark).select("doc_id")
    assert sharding.number_within(sharding.shard(rows, ["doc_id"], [1.0]), "shard", "slot").count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id")
    got = queries.op1_rendezvous_sharding(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.doc_id) == sorted(docs.index)
    for r in got.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
