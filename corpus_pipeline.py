"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes all that its predecessor kept. All but the last return the
columns of `documents`; the last adds the shard. run() writes each stage to the
shared folder and reads it again, as a cluster would between two jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import decontaminate, mixing, near_dup, quality_rules, sharding
from quadloom.llm.duck import on
from quadloom.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.keep(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights."""
    return mixing.keep(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `shard`."""
    return sharding.with_shards(docs)


STAGES = [("quality_rules", quality), ("near_dup", dedup), ("decontaminate", clean_of_benchmark), ("mixing", mixed), ("sharding", sharded)]



def _oracle() -> str:
    """The stages one after the other in DuckDB, each over what the one before kept. doc_ids are not null and do not repeat."""
    shards = on(sharding.sql(), "documents", "drawn_docs")
    return f"""
WITH good_docs AS MATERIALIZED (SELECT * FROM documents SEMI JOIN (SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept) USING (doc_id)),
single_docs AS MATERIALIZED (SELECT * FROM good_docs SEMI JOIN (SELECT class_id AS doc_id FROM ({near_dup.sql("good_docs")})) USING (doc_id)),
clean_docs AS MATERIALIZED (SELECT * FROM single_docs ANTI JOIN (SELECT doc_id FROM ({decontaminate.sql("single_docs")})) USING (doc_id)),
drawn_docs AS MATERIALIZED (SELECT * FROM clean_docs SEMI JOIN (SELECT doc_id FROM ({on(mixing.sql(), "documents", "clean_docs")}) WHERE selected) USING (doc_id))
SELECT drawn_docs.*, shard FROM drawn_docs JOIN (SELECT doc_id, shard FROM ({shards})) USING (doc_id)
"""


ORACLE_SQL = _oracle()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.write(name, stage(spark, docs, sf_dir))
    return docs
