"""Combining aggregates without cross joins.

* :func:`side_by_side` puts several one-row aggregates into one row through a union
  and a ``first(ignorenulls)`` aggregate.
* :func:`attach` adds per-key values to rows: an equi-join on the keys, or -- when there
  are no keys -- scalar subqueries (``DataFrame.scalar()``), which Spark evaluates once
  and inlines, merging several of them into one.

A join on a constant column would be folded into a nested-loop (cross) join; neither
helper ever plans one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row DataFrames (names must differ)."""
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def attach(df: DataFrame, values: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
           how: str = "inner") -> DataFrame:
    """``df`` plus ``cols`` of ``values`` matched on ``keys`` (one ``values`` row per key)."""
    keys = list(keys)
    if keys:
        return df.join(values.select(*keys, *cols), keys, how)
    return df.select("*", *[values.select(c).scalar().alias(c) for c in cols])
