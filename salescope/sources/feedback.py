"""Feedback rows: append and read.

Appending writes new JSON-lines files next to the old ones (no read-modify-write), so
two writers never lose each other's entries.  Reading uses a declared schema and drops
malformed lines instead of discarding the whole set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("rating", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])


def stamp_feedback(df: DataFrame) -> DataFrame:
    """Add the ISO submission time to ``(rating, category, comment)`` rows."""
    return df.select(F.col("rating").cast("int"), F.col("category").cast("string"),
                     F.col("comment").cast("string"),
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                     .alias("timestamp"))


def append_feedback(df: DataFrame, directory: str) -> None:
    """Append stamped feedback rows as JSON lines."""
    stamp_feedback(df).write.mode("append").json(directory)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


CORRUPT = "malformed"
QUARANTINE_SCHEMA = T.StructType([*FEEDBACK_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def split_feedback(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, malformed lines) of rows read with ``QUARANTINE_SCHEMA``; together they are all lines."""
    bad = F.col(CORRUPT).isNotNull()
    return lines.where(~bad).drop(CORRUPT), lines.where(bad).select(F.col(CORRUPT).alias("line"))


def read_feedback_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Every line: an entry, or ``malformed`` with the line as it stands."""
    return spark.read.schema(QUARANTINE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(directory)


def read_feedback(spark: SparkSession, directory: str) -> DataFrame:
    """All feedback entries; empty when the folder is missing."""
    if not _exists(spark, directory):
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    return spark.read.schema(FEEDBACK_SCHEMA).option("mode", "DROPMALFORMED").json(directory)
