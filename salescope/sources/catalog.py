"""Dataset catalogue, de-duplication and the active-dataset choice.

The catalogue is a ``binaryFile`` scan that selects only path, length and modification
time, so the file contents are never read (``content`` is pruned from the read schema).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.functions.formats import basename


def dataset_catalog(spark: SparkSession, directory: str, glob: str = "*.csv",
                    priority: int = 1) -> DataFrame:
    """``(filename, size, uploaded_at, path, priority)`` of the CSV files in ``directory``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", False).load(directory)
             .select("path", "length", "modificationTime"))
    return files.select(basename("path").alias("filename"), F.col("length").alias("size"),
                        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                        .alias("uploaded_at"), "path", F.lit(priority).alias("priority"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key by ``order``.

    ``row_number() == 1`` over a key window: Spark plans a partial WindowGroupLimit
    before the exchange, so a key holding a third of all rows still ships at most one
    row per map task.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def catalog_dedup(catalogs: DataFrame) -> DataFrame:
    """One entry per file name; the lowest ``priority`` (the fallback file, listed first) wins."""
    return first_per_key(catalogs, ["filename"], ["priority", "path"])


def with_active(catalog: DataFrame, active: DataFrame) -> DataFrame:
    """The catalogue with an ``active`` flag on the file that :func:`active_dataset` names."""
    name = active.select(F.col("active_filename").alias("_active")).limit(1)
    return (catalog.join(F.broadcast(name), F.col("filename") == F.col("_active"), "left")
            .withColumn("active", F.col("_active").isNotNull()).drop("_active"))


def select_dataset(spark: SparkSession, catalog: DataFrame, filename: str, config_path: str) -> None:
    """Store the chosen file name as the one-row config table (S10); it must be in the catalogue."""
    chosen = catalog.where(F.col("filename") == filename).select(F.col("filename").alias("active_filename")).limit(1)
    if chosen.isEmpty():
        raise ValueError(f"no such dataset: {filename}")
    spark.createDataFrame([(filename,)], "active_filename string").coalesce(1).write.mode("overwrite").json(config_path)


def read_selection(spark: SparkSession, config_path: str) -> DataFrame:
    return spark.read.schema("active_filename string").json(config_path)


def active_dataset(catalog: DataFrame, config: DataFrame | None, fallback: str | None) -> DataFrame:
    """One row ``(active_filename, source)``: the configured file if it exists, else the
    first CSV by name, else the fallback name (S10).

    ``config`` is a one-row table ``(active_filename)`` or None.  The reference takes
    the first file in directory order, which is unspecified; we take the smallest name.
    """
    names = catalog.select("filename").distinct()
    first = catalog.agg(F.min("filename").alias("first_csv"))
    one = first.withColumn("_one", F.lit(1))
    if config is not None:
        cfg = config.select(F.col("active_filename").alias("cfg")).limit(1)
        hit = cfg.join(names, cfg["cfg"] == names["filename"], "inner").select("cfg")
        one = one.join(hit.withColumn("_one", F.lit(1)), "_one", "left")
    else:
        one = one.withColumn("cfg", F.lit(None).cast("string"))
    fb = F.lit(fallback).cast("string")
    return one.select(
        F.coalesce("cfg", "first_csv", fb).alias("active_filename"),
        F.when(F.col("cfg").isNotNull(), "config").when(F.col("first_csv").isNotNull(), "first")
         .otherwise(F.when(fb.isNotNull(), "fallback")).alias("source"))
