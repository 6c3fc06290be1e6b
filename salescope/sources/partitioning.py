"""Partitioning helpers: parallelism floor and count-checked dimension joins.

Catalyst's automatic broadcast compares *estimated* sizes and may broadcast a fact table
that happens to be small on disk while streaming a five-row dimension -- the whole join
then runs in the one task that holds the dimension.  These helpers make the intent
explicit:

* :func:`dimension_join` broadcasts the dimension only after checking its row count
  against ``salescope.broadcast.maxRows`` (a Parquet ``count()`` reads footers only) and
  rows x row width against ``MAX_BROADCAST_BYTES``; above either it asks for a sort-merge
  join, so the fact side is never broadcast.
* :func:`ensure_parallel` spreads a small file input (one large row group, one small file)
  over the cores before CPU-heavy narrow work.  It looks at the plan's size estimate alone:
  beyond ``SPREAD_MAX_BYTES`` the file splits themselves are many, and nothing is shuffled,
  however many cores the cluster has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS_CONF = "salescope.broadcast.maxRows"
DEFAULT_BROADCAST_MAX_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 512 << 20
# bytes up to which an input is worth a shuffle for parallelism
SPREAD_MAX_BYTES = 1 << 30


def broadcast_max_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_MAX_ROWS_CONF, str(DEFAULT_BROADCAST_MAX_ROWS)))


def ensure_parallel(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Repartition (by ``key`` when given) if the plan's estimate says that ``df`` is small."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_MAX_BYTES:
        return df
    return df.repartition(target, F.col(key)) if key else df.repartition(target)


def dimension_join(fact: DataFrame, dim: DataFrame, on: Column | str | list[str],
                   how: str = "inner", bound_rows: int | None = None,
                   max_rows: int | None = None) -> DataFrame:
    """Join a fact side to a dimension, broadcasting the dimension only when proven small.

    ``bound_rows`` is an upper bound on the dimension's rows when it is derived (for an
    inner join to a unique key, the row count of its own fact side); otherwise the
    dimension is counted.
    """
    cap = max_rows if max_rows is not None else broadcast_max_rows(fact)
    rows = bound_rows if bound_rows is not None else dim.count()
    width = int(dim._jdf.schema().defaultSize())
    side = F.broadcast(dim) if rows <= cap and rows * width <= MAX_BROADCAST_BYTES else dim.hint("merge")
    return fact.join(side, on, how)
