"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept.  All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import jaccard, langid, mixing, packing, pseudonyms
from veilwright.llm.common import stored, table
from veilwright.llm.queries import PSEUDONYM_KEY, held_out
from veilwright.llm.tokens import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, whose language is unknown; a missing label is filled in.

    Where no labelled text is left to learn from, labels stay missing and all documents with a letter stay.
    """
    net = langid.fit(docs.filter(~held_out("doc_id")))
    found = langid.identify(docs, net)
    known = F.nullif("lang_pred", F.lit(langid.UNKNOWN))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    label = F.coalesce("lang", known)
    return found.filter(known.isNotNull() | lettered).select(*[label.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.keep_first(docs)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; lengths in characters stay, but for dates."""
    done = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, found="__found").drop("__found")
    return done.withColumn("n_chars", F.length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids."""
    return packing.pack(docs, vocabulary_path(), 2048)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", distinct_texts),
    ("PII", pseudonymous),
    ("mixing", mixed),
    ("packing", packed),
]
#: Networks, sampled hash paths and packing have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs)
    return docs
