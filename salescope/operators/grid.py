"""Data-grid operations: preview, filter, keyword search, sort, non-blank texts.

Filters are plain predicates, so on Parquet they are pushed into the scan; sorts with a
row limit plan as TakeOrderedAndProject (a per-task top-n, then a merge of n rows per
task) instead of a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.functions.cleaning import py_strip
from salescope.operators.ordering import with_place

PREVIEW_ROWS = 100


def _as_text(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]


def preview_file(spark: SparkSession, path: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows of a Parquet table in file order (files by name), as text,
    missing cells as the empty string (S6, S7 with n=5).

    The rows of the first non-empty files are enough: at most ``n`` file names, picked from row
    counts that Spark reads from the footers, and the filter on the file name prunes the rest.
    """
    whole = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    counted = whole.select(file.alias("f")).groupBy("f").count().orderBy("f").limit(n)
    before = F.sum("count").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    names = [r["f"] for r in counted.select("f", F.coalesce(before, F.lit(0)).alias("b")).where(F.col("b") < n).collect()]
    ordered = whole.where(file.isin(names)).select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row")) \
        .orderBy("_file", "_row").limit(n)
    return ordered.select(*_as_text(ordered.select(*whole.columns)))


def preview(df: DataFrame, order: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows of any table in an explicit order, as text."""
    return df.orderBy(*order).limit(n).select(*_as_text(df))


def nonblank_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts stripped of surrounding whitespace; blank ones dropped (P5)."""
    stripped = py_strip(F.col(text))
    return df.withColumn(text, stripped).where(F.col(text) != "")


def grid_filter(df: DataFrame, **equals: str) -> DataFrame:
    """Rows whose columns equal the given values, e.g. ``category="PROMO"``."""
    cond = F.lit(True)
    for c, v in equals.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def grid_search(df: DataFrame, keyword: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any string column contains ``keyword``, case-insensitive."""
    cols = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    kw = keyword.lower()
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(kw), F.lit(False))
    return df.where(cond)


def grid_sort_places(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Every row with its 0-based ``place`` in :func:`grid_sort`'s order of the whole table: range partitions
    plus the counts of those before, no one-task window (P8)."""
    first = F.col(column).desc() if descending else F.col(column).asc()
    return with_place(df, [first, *[F.col(c).asc() for c in df.columns if c != column]])


def write_sorted(df: DataFrame, column: str, path: str, descending: bool = True) -> None:
    """The whole table sorted, one run of places per file (P8); read back, ``place`` orders it."""
    placed = grid_sort_places(df, column, descending)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "place").sortWithinPartitions("place").write.parquet(path)


def grid_sort(df: DataFrame, column: str, descending: bool = True, n: int | None = None) -> DataFrame:
    """All rows sorted by one column, or the page of the first ``n``; the other columns break
    ties so the result is stable (P8)."""
    first = F.col(column).desc() if descending else F.col(column).asc()
    rest = [F.col(c).asc() for c in df.columns if c != column]
    ordered = df.orderBy(first, *rest)
    return ordered if n is None else ordered.limit(n)
