"""Sharding by a k-d tree over document metadata (native Spark).

Every node covers a range of shards.  A node is split along the metadata dimension in which its
rows spread widest (relative to the spread over all rows), at the weighted median of the bytes
(more generally: at the share of bytes that belongs to the left half of its shards), until every
leaf is one shard.  The medians come from distributed running totals, so a node of any size --
the root holds all rows -- is never gathered in one task, and they are exact: rows of equal
coordinate are ordered by text checksum and document id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import land, running_totals, small, text_or_empty

def text_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def with_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``__<column>``: the rank (from 1) of a string among the distinct ones by UTF-8 bytes; null is 0.

    The ranks of one column are a table of its distinct values, numbered by running totals.
    """
    for c in columns:
        values = rows.filter(F.col(c).isNotNull()).select(F.col(c).alias("__value"), F.lit(1).cast("long").alias("__one")).distinct()
        n = values.count()
        ranks = running_totals(values, [], [F.col("__value")], "__one", "kd-ranks", 1, n).select("__value", F.col("rn").cast("double").alias(f"__{c}"))
        rows = (rows.join(small(ranks, n), F.col(c) == F.col("__value"), "left").drop("__value")
                .withColumn(f"__{c}", F.coalesce(f"__{c}", F.lit(0.0))))
    return rows


def kd_shards(meta: DataFrame, n_shards: int, size: str, dims: list[str], tie: list[str]) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1, bytes near equal) and ``slot`` (gapless from 0 in a shard).

    ``meta``: narrow rows with a non-null ``size`` > 0, numeric ``dims`` (null counts as 0) and
    ``tie`` columns that make the order unique.  Equal rows may swap slots.  An empty table gives
    an empty result.  Cost: one range exchange of the narrow rows for each of the
    ceil(log2(n_shards)) levels; the only thing collected is one row of ranges.
    """
    rows = meta
    for i, d in enumerate(dims):
        rows = rows.withColumn(f"__d{i}", F.coalesce(F.col(d).cast("double"), F.lit(0.0)))
    axes = [f"__d{i}" for i in range(len(dims))]
    wide = rows.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    # the root's number as a column, not a literal: a literal key would turn the first join into a cross join
    root = (F.col(size) * 0).cast("int")
    rows = rows.withColumn("__lo", root).withColumn("__k", F.lit(n_shards)).withColumn("__rn", F.lit(0).cast("long"))
    order = [F.col("__key"), *[F.col(t) for t in tie]]
    for level in range(max(1, math.ceil(math.log2(n_shards)))):
        spreads = [(F.max(a) - F.min(a)) / F.lit(float(wide[a] or 1.0)) for a in axes]
        best = F.greatest(*spreads) if len(spreads) > 1 else spreads[0]
        axis = F.coalesce(*[F.when(s == best, F.lit(i)) for i, s in enumerate(spreads)], F.lit(0))
        nodes = (rows.groupBy("__lo").agg(axis.alias("__axis"), F.sum(size).alias("__total"))
                 .withColumnRenamed("__lo", "__node"))
        key = F.coalesce(*[F.when(F.col("__axis") == i, F.col(a)) for i, a in enumerate(axes)])
        keyed = (rows.join(small(nodes, n_shards), F.col("__lo") == F.col("__node"))
                 .withColumn("__key", key).drop("__axis", "__node", "__rn"))
        totals = running_totals(keyed, ["__lo"], order, size, f"kd{level}", n_shards)
        half = F.when(F.col("__k") > 1, F.floor(F.col("__k") / 2).cast("int")).otherwise(F.lit(1))
        # a row goes left if its middle byte lies in the left share
        left = (F.col("cum") * 2 - F.col(size)) * F.col("__k") <= F.col("__total") * 2 * half
        cut = (totals.withColumn("__half", half).withColumn("__left", left)
               .withColumn("__lo", F.when(F.col("__left"), F.col("__lo")).otherwise(F.col("__lo") + F.col("__half")))
               .withColumn("__k", F.when(F.col("__left"), F.col("__half")).otherwise(F.col("__k") - F.col("__half")))
               .withColumnRenamed("rn", "__rn").drop("cum", "__half", "__left", "__total", "__key"))
        rows = land(cut, f"kd-nodes{level}")
    # a leaf's rows are neighbours in its parent's order
    first = rows.groupBy("__lo").agg(F.min("__rn").alias("__first")).withColumnRenamed("__lo", "shard")
    return (rows.join(small(first, n_shards), F.col("__lo") == F.col("shard"))
            .withColumn("slot", F.col("__rn") - F.col("__first")).drop("__lo", "__k", "__rn", "__first", *axes))


def shard_documents(docs: DataFrame, n_shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Documents' metadata with ``size``, ``text_crc32``, ``shard`` and ``slot``; law ``bytes``.

    Dimensions: source and lang (ranks of their distinct values), log2 of the size and doc_id.  Copies of a
    text share shards only where source, lang and doc_id, which are split first, leave them together.
    Very long texts count with all their bytes; an empty table gives an empty result; other columns are
    not read.  ``target_bytes`` (with n_shards None)
    sets the number of leaves by the total.  Null texts have size 1 and the checksum of an empty
    text; null ids, langs and sources sort first; repeated rows are all kept.
    """
    meta = land(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                            text_size().alias("size"), F.crc32(F.encode(text_or_empty("text"), "UTF-8")).alias("text_crc32"),
                            F.log2(text_size()).alias("__log")), "kd-meta")
    meta = with_ranks(meta, ["source", "lang"]).drop("source", "lang")
    if n_shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, math.ceil(total / target_bytes))
    return kd_shards(meta, n_shards, "size", ["__source", "__lang", "__log", "doc_id"],
                     ["text_crc32", "doc_id"]).drop("__source", "__lang", "__log")
