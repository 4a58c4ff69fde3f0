"""Training-data pipeline: quality, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import bpe, decontaminate, near_dup, pii, quality_model
from loomlog.llm.batches import delete, scratch, shared_dir
from loomlog.llm.queries import good_ids, table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps."""
    return quality_model.keep_good(docs, good_ids(spark, sf_dir))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    found = decontaminate.find_contamination(docs.select(F.struct(*docs.columns).alias("__doc"), "text"), table(spark, sf_dir, "benchmark"), keep=["__doc"])
    return found.filter(~F.col("contaminated")).select("__doc.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each document."""
    encoded = bpe.encode_texts(docs, *vocabulary(), keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_model", quality), ("near_dup", deduplicate), ("decontaminate", drop_contaminated), ("pii", redact), ("bpe", encode)]

#: Stages sample, compare and encode in ways that SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with Parquet in the shared folder between them.

    What a stage leaves there for itself, and what it has read, goes when its
    result is written; the last stage is left to the caller's action.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{i}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
