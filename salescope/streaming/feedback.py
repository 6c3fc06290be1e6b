"""Feedback rows arriving as JSON lines, appended to a Parquet table.

Malformed lines are dropped (the default mode would keep them as all-NULL rows).  The
file sink with a checkpoint in a shared folder is exactly-once: a batch replayed after a
failure is not appended twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salescope.sources.feedback import CORRUPT, FEEDBACK_SCHEMA, QUARANTINE_SCHEMA, split_feedback


def feedback_stream(spark: SparkSession, directory: str) -> DataFrame:
    return (spark.readStream.schema(FEEDBACK_SCHEMA).option("mode", "DROPMALFORMED")
            .json(directory))


def start_feedback_sink(spark: SparkSession, directory: str, output_path: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    w = (feedback_stream(spark, directory).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(output_path)


def start_feedback_quarantine(spark: SparkSession, directory: str, output_path: str, quarantine_path: str, checkpoint: str,
                              available_now: bool = True) -> StreamingQuery:
    """Feedback lines to two tables in the same batch: entries, and malformed lines as they stand.

    Both are partitioned by ``batch`` and a batch replaces its own partitions, so one that is replayed after
    a failure between the two writes adds nothing twice.
    """
    lines = (spark.readStream.schema(QUARANTINE_SCHEMA).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", CORRUPT).json(directory))

    def write_batch(batch: DataFrame, number: int) -> None:
        for part, path in zip(split_feedback(batch), (output_path, quarantine_path), strict=True):
            (part.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    w = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
