"""A training-data pipeline over ``documents``: toxicity, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
Decisions are about rows: of rows that repeat an id each is judged by its own text, and null
ids are judged like others.  Null, empty, very long and repeated texts and empty tables are
handled as the operators' docstrings say; columns beyond those of documents pass through unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import bpe, decontaminate, minhash, toxicity
from quern.scratch import Scratch

#: No SQL for the trained classifier, signatures or merges: the stages are tested against brute force.
ORACLE_SQL = None
#: Rows that a stage broadcasts at most; more of them are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity operator does not predict to be toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least id.

    Rows that repeat the kept id are that document and stay with it; rows with a null id
    stay; a text without near-duplicates stays whatever other rows share its id.
    """
    found = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    found = Scratch(spark).keep(found, "dropped")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    same = (docs["doc_id"] == found["_id"]) & (minhash.version_of(docs["text"]) == found["_version"])
    return docs.join(found, same, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item is found."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding and decoding of what is left: doc_id, n_tokens and digests."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet below the shared folder and read again; what has been read is removed."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        done = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(docs)
        docs = done
    return docs
