"""Places of rows in a total order, without a one-task window or sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.session import materialize
from salescope.sources.partitioning import dimension_join

_MONO = "__mono"


def with_place(df: DataFrame, order: list[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based place in ``order`` over the whole table.

    Rows are range partitioned by ``order`` and sorted inside partitions; a row's place is its index there
    plus the counts of the partitions before (one row per partition).  The sorted rows are checkpointed,
    since their index must not change between counting and numbering.  ``order`` should be total: rows it
    does not tell apart stand in any order.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .withColumn(_MONO, F.monotonically_increasing_id()))
    part, index = F.shiftright(F.col(_MONO), 33), F.col(_MONO).bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
               .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")))
    placed = dimension_join(rows.withColumn("__part", part), offsets, "__part", bound_rows=parts)
    return placed.select(*df.columns, (F.col("__first") + index).alias(name))
