"""Landing cleaned datasets and persisting tables.

Every writer goes through Spark's commit protocol into a shared folder, so a lost
executor only re-runs its task; nothing is kept on a machine-local disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTERS = "seq long, version string"
#: versions of a dataset that stay: the current one, and those that a reader may still hold
KEEP_VERSIONS = 3


def land_dataset(clean: DataFrame, root: str, dataset: str) -> str:
    """Write one cleaned dataset as a new version below ``root/dataset=<name>`` and make it current.

    A version is a folder of its own; a pointer file, which appears whole by the committer's rename,
    makes it the current one.  Until then readers see the version before, and a landing that fails
    leaves no trace but an unreferenced folder.  Also an empty dataset replaces the one before (its
    files then hold the schema alone).  Versions older than the last ``KEEP_VERSIONS`` are removed.
    """
    spark = clean.sparkSession
    home = dataset_path(spark, root, dataset)
    version = uuid.uuid4().hex
    clean.write.parquet(f"{home}/version={version}")
    known = _versions(spark, home)
    seq = known[0][0] + 1 if known else 1
    spark.createDataFrame([(seq, version)], _POINTERS).coalesce(1).write.mode("append").json(f"{home}/_current")
    for _, old in known[KEEP_VERSIONS - 1:]:
        fs, at = _hadoop(spark, f"{home}/version={old}")
        fs.delete(at, True)
    return version


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, home: str) -> list[tuple[int, str]]:
    """(number, version) of one dataset, the latest first: a row per landing."""
    fs, at = _hadoop(spark, f"{home}/_current")
    if not fs.exists(at):
        return []
    rows = spark.read.schema(_POINTERS).json(f"{home}/_current").orderBy(F.desc("seq"), F.desc("version")).collect()
    return [(r["seq"], r["version"]) for r in rows]


def dataset_path(spark: SparkSession, root: str, dataset: str) -> str:
    """Folder of a dataset, its name escaped as Spark escapes partition values."""
    return f"{root.rstrip('/')}/dataset={escaped(spark, dataset)}"


def escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it into a folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def read_dataset(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The current version of a landed dataset; no other folder is listed."""
    home = dataset_path(spark, root, dataset)
    known = _versions(spark, home)
    if not known:
        raise ValueError(f"no such dataset: {dataset}")
    return spark.read.parquet(f"{home}/version={known[0][1]}")


def write_vector_table(vectors: DataFrame, path: str) -> None:
    """Persist ``(id, text, idx, val)`` rows: text and vector share a row."""
    vectors.write.mode("overwrite").parquet(path)


def read_vector_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_reports(reports: DataFrame, path: str, key: str = "report_key",
                  text: str = "report") -> None:
    """One text file set per report key."""
    reports.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


def write_csv_file(lines: DataFrame, path: str) -> None:
    """The one text column of ``lines`` as a single file of that name, for stores that list files by name.

    One file is one task's work: for exports of bounded size.  The finished file is moved into place.
    """
    spark = lines.sparkSession
    fs, folder = _hadoop(spark, f"{path}.parts")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    _, target = _hadoop(spark, path)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)
