"""Session construction and the shared checkpoint folder.

On a cluster the operator reads ``spark.checkpoint.dir`` from the session (a shared
folder such as an object-store prefix).  Only when it is unset -- local tests and the
bench -- do we create a scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all of them are standard Spark options.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "salescope", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library is designed for."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SALESCOPE_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and landed tables.

    Reads ``spark.checkpoint.dir``; when unset, local-mode sessions (tests, local runs)
    get a fresh scratch folder, and cluster sessions fail fast instead of writing to a
    machine-local disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive a lost executor on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        conf_dir = tempfile.mkdtemp(prefix="salescope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a small derived table that several branches read.

    A reliable ``checkpoint`` into the shared checkpoint folder (never a local one):
    the branches read the written files instead of recomputing the plan once each, and
    a lost executor does not force the upstream job to run again.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
