"""Sales CSV scan and cleaning.

The read declares nothing about types: every column arrives as a string and is then
coerced explicitly, so a malformed number or a stray ``NA`` never changes a column's
type the way schema inference would.  Cleaning is a single projection (no shuffle) and
runs on the executors.
"""

from __future__ import annotations

import csv as _csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.functions.cleaning import apply_na_tokens, na_to_null, parse_mixed_date, to_number
from salescope.session import materialize
from salescope.sources.partitioning import dimension_join

# The reference's column names and the canonical names we give them.
REFERENCE_COLUMNS = {
    "Order Date": "order_date",
    "Region": "region",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Segment": "segment",
    "Product Name": "product_name",
    "Sales": "sales",
    "Discount": "discount",
    "Profit": "profit",
}
NUMERIC = ("sales", "discount", "profit")
#: different header lines that one read may meet
MAX_LAYOUTS = 200


def read_csv_raw(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1",
                 multi_line: bool = False) -> DataFrame:
    """Header CSV, all columns as strings, quotes escaped by doubling.

    ``encoding`` defaults to Latin-1, which accepts every byte.  ``multi_line`` allows
    newlines inside quoted cells but makes each file one task (not splittable), so land
    such files to Parquet once (:func:`salescope.sources.landing.land_dataset`).  Files must
    share one header: another order of columns fails the read (``enforceSchema`` is off)
    instead of shifting cells; :func:`read_sales_csv` reads mixed layouts by name.
    """
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .csv(path))


def file_layouts(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Header line of every non-empty file: ``(file, header)``, found on the executors.

    The first line of a file is the first row of its block at offset 0; each task keeps one candidate
    per file before the shuffle.  Nothing is opened, listed or read on the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    return (lines.where(F.col("at") == 0).withColumn("nth", F.monotonically_increasing_id())
            .groupBy("file").agg(F.min_by("line", "nth").alias("header")))


def _names(header: str) -> list[str]:
    """Column names of a header line, stripped; a name that comes again gets its place appended."""
    cells = [c.strip() for c in next(_csv.reader([header]), [])]
    return [c if cells.index(c) == i and c else f"{c or '_c'}{i}" for i, c in enumerate(cells)]


def read_sales_csv(spark: SparkSession, path: str | list[str], file_column: str | None = None, encoding: str = "ISO-8859-1",
                   multi_line: bool = False) -> DataFrame:
    """Raw CSV with stripped header names and missing-value tokens as NULL.

    Columns are matched by name.  A table of layouts is made from the files' first lines
    (:func:`file_layouts`); only its distinct headers reach the driver.  Files of one layout are read
    as they are; where layouts differ, all files are read at once by position, and each row's
    layout says which position holds which column.  A column that a layout lacks is NULL.
    ``file_column`` adds the full path of each row's file.
    """
    found = file_layouts(spark, path, encoding)
    # distinct headers are few: layouts, not files
    headers = [r["header"] for r in found.select("header").distinct().orderBy("header").limit(MAX_LAYOUTS + 1).collect()]
    if len(headers) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different header lines")
    file = F.col("_metadata.file_path").alias(file_column) if file_column else None
    if len(headers) < 2:
        raw = read_csv_raw(spark, path, encoding, multi_line)
        names = _names(headers[0]) if headers else [c.strip() for c in raw.columns]
        if file is None:
            return apply_na_tokens(raw.toDF(*names))
        return apply_na_tokens(raw.select("*", file).toDF(*names, file_column), names)
    places = [{n: i for i, n in enumerate(_names(h))} for h in headers]
    width = max(len(p) for p in places)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    rows = (spark.read.schema(schema).option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    # one small number per file instead of its header; broadcast only while the files are few
    number = F.coalesce(*[F.when(F.col("header") == h, F.lit(i)) for i, h in enumerate(headers)])
    layouts = materialize(found.select(F.col("file").alias("__file"), number.alias("__layout")))
    rows = rows.select("*", F.col("_metadata.file_path").alias("__path"))
    rows = dimension_join(rows, layouts, F.col("__path") == F.col("__file"))

    def column(name: str) -> Column:
        at: dict[int, list[int]] = {}
        for i, p in enumerate(places):
            if name in p:
                at.setdefault(p[name], []).append(i)
        return F.coalesce(*[F.when(F.col("__layout").isin(own), F.col(f"_c{place}")) for place, own in at.items()])

    names = list(dict.fromkeys(n for p in places for n in p))
    cells = [na_to_null(column(n)).alias(n) for n in names]
    return rows.select(*cells, *([F.col("__path").alias(file_column)] if file_column else []))


def clean_sales(df: DataFrame, columns: dict[str, str] | None = None,
                strict_dates: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map to canonical columns, numbers with 0 default (S4), mixed-format dates.

    A bad or missing number becomes 0 and counts in means, as in the reference.  With
    ``strict_dates`` a date that matches no layout fails the job; otherwise it is NULL.
    Columns absent from ``df`` raise at analysis time (as a missing column does).
    ``keep`` names extra columns passed through unchanged.
    """
    mapping = columns or REFERENCE_COLUMNS
    present = {src: dst for src, dst in mapping.items() if src in df.columns}
    out = []
    for src, dst in present.items():
        c = F.col(f"`{src}`")
        if dst in NUMERIC:
            out.append(to_number(c).alias(dst))
        elif dst == "order_date":
            out.append(parse_mixed_date(c, strict=strict_dates).alias(dst))
        else:
            out.append(c.cast("string").alias(dst))
    missing = [d for d in NUMERIC if d not in present.values()]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*keep, *out)
