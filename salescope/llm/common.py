"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage: later branches read files every executor can reach, so a lost executor
    costs a re-read, not a re-run of the plan above.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def row_key() -> tuple[Column, Column]:
    """128 bits that name a document by its id and its text; rows without an id are told apart by their texts.

    A null text counts as an empty one.
    """
    t, d, bare = text_or_empty("text"), F.col("doc_id"), F.col("doc_id").isNull()
    return F.xxhash64(d, bare, t), F.xxhash64(t, d, bare)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is faster and equal on pure ASCII texts."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_array(c: Column) -> Column:
    """Maximal runs of characters other than space and \\t..\\r."""
    trimmed = F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


#: rows up to which a table that was counted, or is bounded by a parameter, is broadcast
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if ``rows``, its row count or a proven bound of it, allows that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: rows of a narrow table that one range partition is worth
ROWS_PER_RANGE = 20_000


def running_totals(df: DataFrame, group: list[str], order: list[Column], weight: str, name: str,
                   n_groups: int, rows: int | None = None) -> DataFrame:
    """Add ``cum`` (sum of ``weight``) and ``rn`` (row count), both inclusive, in ``order`` within ``group``.

    A window over a group would put a group of any size into one task.  Here rows are range
    partitioned by (group, order), whatever the size of a group, and landed with their partition
    number; the totals per (group, partition) -- one row per partition and group -- give each
    partition's offset (at most partitions + ``n_groups`` rows).  ``order`` should be unique within
    the group: ties take any order.  ``rows``, where known, keeps a small table from being dealt to
    many files.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = min(parts, rows // ROWS_PER_RANGE + 1)
    dealt = (df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
             .withColumn("__part", F.spark_partition_id()))
    landed = land(dealt, name)
    keys = [F.col(g) for g in group]
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (landed.groupBy("__part", *group).agg(F.sum(weight).alias("__w"), F.count("*").alias("__n"))
               .select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                       F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w0"),
                       F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0")))
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    here = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (landed.join(small(offsets, parts + n_groups), on)
            .withColumn("cum", F.col("__w0") + F.sum(weight).over(here))
            .withColumn("rn", F.col("__n0") + F.row_number().over(here))
            .drop("__part", "__p", "__w0", "__n0", *[f"__g{i}" for i in range(len(group))]))
