"""Training-corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and works on all that its
predecessor kept.  ``run`` writes every stage's result as Parquet into the shared checkpoint folder and
reads it back as the next one's documents.  There is no SQL for the whole: language ID is a learned
model; the stages are tested against brute force one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import decontam, kdshard, langid, mixing, neardup
from salescope.llm.common import documents, land
from salescope.llm.queries import MIX_EPOCHS, MIX_RATIO, N_SHARDS

#: target languages (None: all that the documents' labels teach) and the least score of a prediction
LANGUAGES, MIN_SCORE = None, langid.MIN_SCORE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are predicted to be in one of ``LANGUAGES`` with a score of ``MIN_SCORE`` or more."""
    return langid.keep_identified(docs, LANGUAGES, MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one_of_each(docs, k=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover at least a twentieth."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated or left out to meet the sources' word targets."""
    return mixing.mix_documents(docs, MIX_RATIO, MIX_EPOCHS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return kdshard.shard_documents(docs, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mix_sources", mix_sources), ("shard", shard)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
