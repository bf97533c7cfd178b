"""Documents through five stages: quality classifier, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, of the documents they keep: the
first three drop what they reject, the fourth keeps every document and cuts the secrets out of its text.

Defined cases, for every stage: a null text is an empty one, which the quality rules reject; null languages and sources are
groups of their own; a null id names nothing, so such rows are never duplicates, and are packed under a null id; rows of
one id with different texts are different documents, equal rows of both are one after the third stage; texts of any length are
taken whole; with labels of one class only nothing is rejected by the first stage, and a warning says so; more columns, and
columns whose names clash with those of results, pass through the first four stages as they are; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinsework.llm import classifier, packing, quality_rules, secrets, simhash
from rinsework.session import prepare, staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.keep_first(docs, simhash.similar_documents(docs, least=0.8, width=5))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("secret_scans", secret_scans), ("packing", pack)]

ORACLE_SQL = None  # the classifier and the fingerprints are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
