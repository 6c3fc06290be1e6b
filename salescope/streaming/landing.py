"""Per-dataset KPIs that follow the CSV files of a folder.

Every file is a dataset of its own, known by its full path.  The state is a manifest: which version
(time and length) of which file the result table holds.  A refresh compares the folder's listing with
it, reads the files that are new or changed, and replaces their sums -- a file that lands again
retracts what it gave before, a file that is gone takes its sums along, and a refresh that is replayed
finds nothing to do.  The sums of a file are written before its manifest row, so a refresh that is
interrupted is simply repeated.

The stream refreshes when it starts and with every micro-batch.  Arrivals come from a ``binaryFile``
source whose content column is pruned, so no byte of a file is read by it; since that source knows
paths only and would not notice a file that lands again, a running stream also ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salescope.functions.metrics import margin_pct
from salescope.operators.ordering import with_place
from salescope.session import materialize
from salescope.sources.csv import clean_sales, read_sales_csv
from salescope.sources.landing import escaped

# files per micro-batch: bounds the list of names that reaches the driver
MAX_FILES_PER_TRIGGER = 1000
TICK_SECONDS = 30
#: partition columns of the result and the manifest: a path's last part, and a digest of the rest
PARTITION = ("file", "folder")


def _files(reader, directory: str, recursive: bool):
    return (reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive).load(directory))


def landing_files(spark: SparkSession, directory: str, recursive: bool = False,
                  max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Stream of ``(path, length)`` of the CSV files that arrive in ``directory``."""
    return _files(spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger), directory, recursive).select("path", "length")


def full_path(path: Column, is_uri: bool = False) -> Column:
    """One spelling of a path: decoded if it is a URI, and without an empty authority."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if is_uri else path
    return F.regexp_replace(plain, "^([a-z0-9]+):///", "$1:/")


def _parts(path: Column) -> list[Column]:
    return [F.substring_index(path, "/", -1).alias("file"),
            F.substring(F.md5(F.regexp_replace(path, "[^/]*$", "")), 1, 16).alias("folder")]


def landing_kpis(rows: DataFrame, keys: Sequence[str] = ("region",), by: Sequence[str] = ("file",)) -> DataFrame:
    """Sums and margin per (file, keys); rows in which any key is NULL are left out."""
    keys, by = list(keys), list(by)
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    agg = known.groupBy(*by, *keys).agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    return agg.select(*by, *keys, "sales", "profit", margin_pct("profit", "sales").alias("margin"))


def manifest_path(output_path: str) -> str:
    return f"{output_path.rstrip('/')}_files"


def _manifest(spark: SparkSession, output_path: str) -> DataFrame:
    schema = "path string, version string, kept boolean, file string, folder string"
    path = manifest_path(output_path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where("kept")


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)


def refresh_landing(spark: SparkSession, directory: str, output_path: str, keys: Sequence[str] = ("region",),
                    recursive: bool = False, max_files: int = MAX_FILES_PER_TRIGGER) -> int:
    """Bring the result table in line with the folder; how many files were read or taken out."""
    listed = _files(spark.read, directory, recursive)
    path = full_path(F.col("path"))
    now = listed.select(path.alias("path"), F.concat_ws("/", F.col("modificationTime").cast("string"), F.col("length")).alias("version"))
    held = _manifest(spark, output_path).select(F.col("path").alias("had"), F.col("version").alias("was"))
    both = now.join(held, F.col("path") == F.col("had"), "full_outer")
    due = materialize(both.where(~F.col("version").eqNullSafe(F.col("was")))
                      .select(F.coalesce("path", "had").alias("path"), "version", F.col("version").isNotNull().alias("kept")))
    total = due.count()
    # by place, in steps of at most ``max_files`` names
    ranked = with_place(due, [F.col("path")]).withColumn("step", F.floor(F.col("place") / max_files)).drop("place") if total > max_files else due
    for step in range(-(-total // max_files)):
        names = due if total <= max_files else ranked.where(F.col("step") == step).drop("step")
        names = materialize(names)
        _refresh_files(spark, names, output_path, list(keys))
    return total


def _refresh_files(spark: SparkSession, names: DataFrame, output_path: str, keys: list[str]) -> None:
    paths = [r["path"] for r in names.where("kept").select("path").collect()]
    done = names.select("path", *_parts(F.col("path")))
    if paths:
        rows = clean_sales(read_sales_csv(spark, [_literal(p) for p in paths], file_column="__file"), strict_dates=False, keep=("__file",))
        named = rows.withColumn("path", full_path(F.col("__file"), is_uri=True)).drop("__file")
        sums = materialize(landing_kpis(named, keys, by=("path",)))
        _replace(sums.select("*", *_parts(F.col("path"))), output_path)
        done = done.join(sums.select("path").distinct(), "path", "left_anti")
    # files that give no row any more: dynamic overwriting leaves their old sums, so these go by hand
    jvm = spark.sparkContext._jvm
    for r in done.collect():
        at = jvm.org.apache.hadoop.fs.Path(f"{output_path.rstrip('/')}/file={escaped(spark, r['file'])}/folder={r['folder']}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _replace(names.select("path", "version", "kept", *_parts(F.col("path"))), manifest_path(output_path))


def _literal(path: str) -> str:
    """A path in which no character is a pattern."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def start_landing_kpis(spark: SparkSession, directory: str, checkpoint: str, output_path: str,
                       keys: Sequence[str] = ("region",), available_now: bool = True,
                       recursive: bool = False, max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> StreamingQuery:
    """Start the KPI stream; the result is a Parquet table partitioned by ``file`` and ``folder``, with the
    full ``path`` of each row's file."""

    def refresh(session: SparkSession) -> None:
        refresh_landing(session, directory, output_path, keys, recursive, max_files_per_trigger)

    refresh(spark)
    arrivals = landing_files(spark, directory, recursive, max_files_per_trigger).select("path")
    if not available_now:
        tick = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        arrivals = arrivals.unionByName(tick.select(F.lit(None).cast("string").alias("path")))
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _epoch: refresh(batch.sparkSession))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{TICK_SECONDS} seconds")).start()
