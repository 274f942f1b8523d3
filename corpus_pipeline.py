"""Corpus preparation: stages over the documents table, each written and read again before the next.

quality        documents that the classifier scores under 0.7 go
near_copies    of each group of documents that link at 5-word shingles and a Jaccard
               similarity of 0.8, the one of the smallest doc_id stays
repeats        strings of 200 bytes that occur elsewhere go from the texts
decontaminate  documents that hold a 10-word window of a benchmark item go
encode         pieces of each text, its N best segmentations (scores and pieces) and a round trip of each
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import decontaminate, jaccard, pieces, quality, suffix_dedup
from inkspan.llm.shared import shared_dir, table

#: Rows that go to a Python worker in one Arrow batch.  Spark's 10,000 are tens of MB of texts, which both sides hold several times.
BATCH = 1024


def sparing(stage):
    """The stage with batches of at most BATCH rows between the JVM and its Python workers.

    Spark reads this setting of the session when it runs a plan, so it holds for later queries, too; a smaller one stays.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH:
            spark.conf.set(key, BATCH)
        return stage(spark, docs, sf_dir)

    return run


@sparing
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@sparing
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, size=5, percent=80)


@sparing
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@sparing
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@sparing
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = pieces.encode(docs.select("doc_id", "text"))
    return made.select("doc_id", "text", "ids", "n_best_scores", "n_best", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
