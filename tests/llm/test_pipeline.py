import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.edge import SCHEMA, edge, empty
from tests.llm.test_jaccard import brute

from veilwright.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run(spark, docs, sf_dir="unused"):
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        yield docs


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    language, distinct, private, mixed, packed = run(spark, docs)
    assert all(d.columns == COLUMNS for d in (language, distinct, private, mixed))
    assert language.count() == docs.count()
    classes = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in distinct.collect()} == {top for top, _ in classes.values()}
    assert {r.doc_id for r in private.collect()} == {r.doc_id for r in distinct.collect()}
    assert not private.filter("text rlike '@mail[0-9].example.com'").join(distinct.select("doc_id", "text"), ["doc_id", "text"]).count()
    times = mixed.groupBy("doc_id").count().toPandas()
    assert times["count"].max() <= 3 and set(times.doc_id) <= {r.doc_id for r in private.collect()}
    heads = packed.filter("start = 0").count()
    assert heads == mixed.count()


def test_difficult_rows(spark):
    for docs in (edge(spark), empty(spark)):
        *kept, packed = run(spark, docs)
        assert all(d.columns == docs.columns for d in kept)
        packed.count()


def test_no_labels_at_all(spark):
    docs = edge(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.known_language(spark, docs, "unused")
    lettered = sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    assert kept.count() == lettered > 5 and kept.filter("lang is not null").count() == 0


def test_run(spark, tmp_path):
    edge(spark).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert SCHEMA
