"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import (
    fingerprints,
    forest,
    jaccard,
    langid,
    mixing,
    negatives,
    packing,
    pieces,
    pseudonyms,
    repair,
    sharding,
    spans,
    walsh,
)
from veilwright.llm.common import gone_with_session, shared_folder, table
from veilwright.llm.tokens import vocabulary_path

#: Key of the pseudonyms in the registered queries; in production a secret.
PSEUDONYM_KEY = "registered query"
#: Ids in the vocabulary of the token operators; the next number is a grammar's first symbol.
VOCABULARY_IDS = 50_257

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@register
def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight equal shards by document id."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.number_within(sharding.shard(rows, ["doc_id"], [1.0] * 8), "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def held_out(doc_id: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


@register
def op2_byte_convolution_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    documents = table(spark, sf_dir, "documents")
    net = langid.fit(documents.filter(~held_out("doc_id")))
    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return langid.identify(rows, net).select("doc_id", "held_out", "lang_pred", "score")


@register
def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that stand in an earlier place."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(documents)


@register
def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the personal data in their texts replaced by pseudonyms."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(documents, PSEUDONYM_KEY)


@register
def op5_chosen_path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents and the number of links of each document."""
    return jaccard.join(table(spark, sf_dir, "documents")).drop("first", "text_hash")


@register
def op6_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 5, 2, 1, repeating, to as many words as there are."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


@register
def op7_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in grammar-compressed files, and what these files give back."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    repair.write(table(spark, sf_dir, "documents"), path, vocabulary_path(), VOCABULARY_IDS)
    gone_with_session(spark, path)
    return repair.catalogue(spark, path)


@register
def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), 2048)


@register
def op9_edit_embedding_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@register
def op10_projection_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


@register
def op11_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


@register
def op12_walsh_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    return walsh.cluster(table(spark, sf_dir, "embeddings"))


@register
def op13_offset_preserving_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces, and the texts these give back."""
    model = pieces.model_path()
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model)
    rows = encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    decoded = pieces.decode(rows, model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes")


# Each row's hash decides, as in the query: rows of a source in hash order up to its budget, then one more.
SQL["op6_hash_threshold_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 12) AS BIGINT) AS hash FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
        ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS most FROM s),
    r AS (SELECT *, most / weight < ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(most) OVER o, 0))
        / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS "full" FROM w
        WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, CASE WHEN "full" THEN most ELSE least(weight * ((SELECT sum(source_size) FROM r)::DOUBLE
        - (SELECT coalesce(sum(most), 0) FROM r WHERE "full")) / (SELECT sum(weight) FROM r WHERE NOT "full"), most) END AS target FROM r),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
    b AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS budget, coalesce(sum(size) OVER (
        PARTITION BY d.source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
        FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
    c AS (SELECT source, hash AS cut, least(floor((budget - spent) / size), 1) AS fits,
        budget - spent - least(floor((budget - spent) / size), 1) * size AS rest
        FROM b WHERE spent < budget AND budget <= spent + size),
    f AS (SELECT b.source, arg_min(hash, (abs(size - rest), hash)) AS filler FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source
        WHERE (hash > cut OR hash = cut AND fits < 1) AND abs(size - rest) < rest GROUP BY b.source),
    m AS (SELECT b.*, CASE WHEN hash < cut THEN 1 WHEN hash = cut THEN fits ELSE 0 END
        + CASE WHEN hash = filler THEN 1 ELSE 0 END AS more FROM b LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source
        LEFT JOIN f ON b.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, size, source_size, target, CAST(whole + least(more, 1) AS BIGINT) AS times,
    CAST(size * (whole + least(more, 1)) AS BIGINT) AS taken FROM m"""

FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

# Every pair of an anchor and another row is scored.
SQL["op11_angular_hard_negatives"] = f"""
WITH r AS (SELECT vec_id, row_number() OVER () AS n, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {FINITE}),
    s AS (SELECT a.n AS anchor, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS alike,
        CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.n <> b.n WHERE a.vec_id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE alike QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""


def _round_sql(number: int) -> str:
    """Assignment to the centroids before the round, and the centroids after it."""
    return f"""
    a{number} AS (SELECT v.n, v.vec_id, c.cluster, list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v) AS d
        FROM v, c{number} c QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY d, c.cluster) = 1),
    m{number} AS (SELECT cluster, i, floor(sum(v.v[i]) / count(*)) AS x FROM a{number} JOIN v USING (n),
        (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
    c{number + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{number} c
        LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM m{number} GROUP BY cluster) m USING (cluster))"""


# Distances of every vector to every centroid, three rounds and a last assignment.
SQL["op12_walsh_hadamard_clusters"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM v
        WHERE vec_id IS NOT NULL QUALIFY cluster < 16),{",".join(_round_sql(i) for i in range(4))},
    t AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT a3.vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(a3.d AS BIGINT) AS distance, cluster_inertia,
    CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c3.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster) JOIN t USING (cluster)"""
