"""Corpus pipeline: quality rules, near-dedup, substring dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame; all but the last return the columns of ``documents``.  run() writes each stage's rows as
Parquet in the shared folder and reads them again for the next; what a later stage has replaced is deleted.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further
columns, whatever their names:

* a null text has no words, so the quality rules reject it; where they are left out, later stages keep it;
* rows without a doc_id are nobody's copy: near-dedup and substring dedup leave them as they are;
* of rows that repeat a doc_id near-dedup keeps one, that of the least text, if it keeps the id at all;
* ties between documents of one group go to the smallest doc_id; texts are never cut short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from provena.llm import common, minhash, packing, quality, secrets, substring

#: Near-duplicate documents share four of five shingles of five words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged, in one pass; without labels the base rules alone decide."""
    common.small_batches(spark)
    return quality.kept_documents(docs, quality.weights_for(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id, unchanged."""
    common.small_batches(spark)
    found = minhash.near_duplicates(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    return minhash.one_of_each(docs, found)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that an earlier document or place has are cut out."""
    common.small_batches(spark)
    return substring.remove_from_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced by their kind."""
    common.small_batches(spark)
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed piece."""
    common.small_batches(spark)
    return packing.documents_packed(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Line labelling, tokens and packing have no SQL form: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents under sf_dir."""
    common.shared_dir(spark)
    home = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            common.delete_folder(spark, home)  # the last stage keeps its pieces in files of its own
            return out
        out.write.parquet(f"{home}/{k}_{name}")
        docs = spark.read.parquet(f"{home}/{k}_{name}")
        if k:
            common.delete_folder(spark, f"{home}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
