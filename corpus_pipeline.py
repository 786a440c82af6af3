"""A corpus from raw documents to token ids: quality rules, near copies, repeated passages, mixing, encoding.

Results that hold by definition, stage by stage (the operators' modules say more):

* null, empty and blank texts fail the rules and go; nulls in other columns change
  nothing; a null id passes, is compared with nothing, is never cut and is mixed
  and encoded like any other;
* of rows that repeat an id, or documents that are near copies, one stays: there
  are no ties, as the least id and then the least text hash decide; mixing may
  then use a row several times;
* very long texts are read whole in every stage;
* an empty table, or one without labels, goes through: without labels all mass is
  on one domain;
* extra columns of the documents, whatever their names, reach the mixing stage
  untouched; the last stage returns the columns of ``KEEP`` with the ids.

The stages' results are written to the shared folder. Each is removed when the
next is written; the last stays, as the caller reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe_codec, quality_rules, simhash_dedup, source_mixing, suffix_dedup
from tidewell.llm.common import remove, shared_dir, table

#: Columns of the documents that the last stage keeps.
KEEP = ["doc_id", "lang", "source"]

#: Null: neither fingerprints nor suffix arrays nor a classifier can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality_rules.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occurred before; ``n_chars`` follows the text."""
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. The classifier learns from the labelled documents as they were at first."""
    return source_mixing.apply_mix(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    return bpe_codec.encode(docs, keep=KEEP)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("repeated passages", repeats), ("mixing", mixing), ("encoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
