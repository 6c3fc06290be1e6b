"""KPI aggregations over a sales table.

All aggregates are algebraic (sum, count, avg, covariance), so Spark plans a partial
HashAggregate before the shuffle: a hot key (one region holding a third of all rows)
collapses to one row per map task before it is exchanged, and skew never reaches the
reducer.  Null group keys are dropped per grouping (pandas ``groupby`` semantics), and
every ordering carries the keys as an ascending tie-break so limits are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.metrics import (
    exact_mean, margin_pct, mean_of_parts, mean_parts, merged_parts, merged_pearson, pearson, pearson_of_parts, pearson_parts)


def _not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _measures(sales: str, profit: str, discount: str | None) -> list[Column]:
    out = [F.sum(sales).alias("sales"), F.sum(profit).alias("profit")]
    if discount is not None:
        # unweighted mean of the row discounts, as a percentage (order-independent sum)
        out.append((exact_mean(discount) * 100.0).alias("discount"))
    return out


def kpi_overall(df: DataFrame, sales: str = "sales", profit: str = "profit",
                discount: str = "discount") -> DataFrame:
    """One row: total sales, total profit, margin, mean discount (A1).

    Empty input gives sums of 0, margin 0 and a NULL mean.
    """
    agg = df.agg(F.coalesce(F.sum(sales), F.lit(0.0)).alias("total_sales"),
                 F.coalesce(F.sum(profit), F.lit(0.0)).alias("total_profit"),
                 (exact_mean(discount) * 100.0).alias("avg_discount"))
    return agg.select("total_sales", "total_profit",
                      margin_pct("total_profit", "total_sales").alias("overall_margin"),
                      "avg_discount")


def kpi_by(df: DataFrame, keys: Sequence[str], sales: str = "sales", profit: str = "profit",
           discount: str | None = None) -> DataFrame:
    """Sums, margin and (optionally) mean discount per key combination (A2-A5)."""
    keys = list(keys)
    agg = df.where(_not_null(keys)).groupBy(*keys).agg(*_measures(sales, profit, discount))
    cols = keys + ["sales", "profit", margin_pct("profit", "sales").alias("margin")]
    if discount is not None:
        cols.append("discount")
    return agg.select(*cols)


def kpi_region(df: DataFrame, key: str = "region", **kw) -> DataFrame:
    return kpi_by(df, [key], **kw)


def kpi_category(df: DataFrame, key: str = "category", discount: str = "discount", **kw) -> DataFrame:
    return kpi_by(df, [key], discount=discount, **kw)


def kpi_subcategory(df: DataFrame, keys: Sequence[str] = ("category", "sub_category"),
                    discount: str = "discount", **kw) -> DataFrame:
    return kpi_by(df, keys, discount=discount, **kw)


def kpi_segment(df: DataFrame, key: str = "segment", **kw) -> DataFrame:
    return kpi_by(df, [key], **kw)


# The breakdowns the analysis and fact jobs need, by grain name.
GRAINS = {
    "overall": (),
    "region": ("region",),
    "category": ("category",),
    "subcategory": ("category", "sub_category"),
    "segment": ("segment",),
    "product": ("sub_category", "product_name"),
}
GRAIN_KEYS = ["region", "category", "sub_category", "segment", "product_name"]


def grain_bitmask(keys: Sequence[str], all_keys: Sequence[str] = GRAIN_KEYS) -> int:
    """``grouping_id`` value of a grouping set: bit set for every key NOT grouped, first key MSB."""
    n = len(all_keys)
    return sum(1 << (n - 1 - i) for i, k in enumerate(all_keys) if k not in keys)


def kpi_grouping_sets(df: DataFrame, grains: dict[str, tuple[str, ...]] | None = None,
                      sales: str = "sales", profit: str = "profit",
                      discount: str = "discount", with_corr: bool = False) -> DataFrame:
    """All breakdowns in one pass.

    All measures are mergeable, so the rows are first aggregated once by all keys that the
    wanted grains use, and the GROUPING SETS expand only those groups, not the rows.  Products
    are many: their grain is an aggregate of its own beside the few groups of the others.
    ``grouping_id`` tells a rolled-up NULL from a NULL key; rows whose own grouping key is
    NULL are dropped, as a per-grouping ``groupBy`` would.
    """
    grains = grains or GRAINS
    many = {k: g for k, g in grains.items() if "product_name" in g}
    if many and len(many) < len(grains):
        few = {k: g for k, g in grains.items() if k not in many}
        one, two = (kpi_grouping_sets(df, g, sales, profit, discount, with_corr) for g in (few, many))
        return one.unionByName(two)
    keys = GRAIN_KEYS
    used = [k for k in keys if any(k in g for g in grains.values())]
    parts = mean_parts(discount, "_d") + (pearson_parts(discount, profit, "_c") if with_corr else [])
    rows = df
    df = rows.groupBy(*used).agg(F.sum(sales).alias("_sales"), F.sum(profit).alias("_profit"), *parts)
    df = df.select(*[F.col(k) if k in used else F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys],
                   *[c for c in df.columns if c.startswith("_")])
    sets = [[F.col(k) for k in g] for g in grains.values()]
    gid = F.grouping_id(*[F.col(k) for k in keys])
    extra = merged_pearson("_c") if with_corr else []
    agg = df.groupingSets(sets, *keys).agg(F.sum("_sales").alias("sales"), F.sum("_profit").alias("profit"),
                                           *merged_parts("_d"), *extra, gid.alias("_gid"))
    agg = agg.withColumn("discount", mean_of_parts("_d") * 100.0)
    if with_corr:
        agg = agg.withColumn("corr_discount_profit", pearson_of_parts("_c"))
    grain = None
    keep = F.lit(False)
    for name, g in grains.items():
        m = grain_bitmask(g, keys)
        grain = F.when(F.col("_gid") == m, F.lit(name)) if grain is None \
            else grain.when(F.col("_gid") == m, F.lit(name))
        keep = keep | ((F.col("_gid") == m) & _not_null(g))
    return agg.where(keep).select(
        grain.alias("grain"), *keys, "sales", "profit",
        margin_pct("profit", "sales").alias("margin"), "discount",
        *(["corr_discount_profit"] if with_corr else []))


def loss_subcategories(df: DataFrame, key: str = "sub_category", sort: bool = True,
                       **kw) -> DataFrame:
    """Sub-categories with negative total profit, most negative first.

    ``sort=False`` skips the final global sort when a consumer orders the rows itself
    (summaries, reports and JSON export all do).
    """
    agg = kpi_by(df, [key], discount=kw.pop("discount", "discount"), **kw)
    out = agg.where(F.col("profit") < 0).select(key, "profit", "sales", "discount")
    return out.orderBy(F.col("profit").asc(), F.col(key).asc()) if sort else out


def top_losses(df: DataFrame, keys: Sequence[str], k: int, **kw) -> DataFrame:
    """The k most loss-making key combinations among those with negative profit.

    "filter < 0, then take k" equals "take k, then filter < 0".  The limit is the
    feature here (a top-k report); Spark plans it as TakeOrderedAndProject, a per-task
    top-k followed by a merge of k rows per task.
    """
    keys = list(keys)
    agg = kpi_by(df, keys, discount=kw.pop("discount", "discount"), **kw)
    order = [F.col("profit").asc()] + [F.col(c).asc() for c in keys]
    return agg.where(F.col("profit") < 0).orderBy(*order).limit(k) \
        .select(*keys, "profit", "sales", "discount")


def loss_products(df: DataFrame, k: int = 10, keys: Sequence[str] = ("sub_category", "product_name"),
                  **kw) -> DataFrame:
    """Top-k loss-making products by (sub-category, product) (A8); k=10 analysis, 15 facts."""
    return top_losses(df, keys, k, **kw)


def worst_subcategories(df: DataFrame, k: int = 3,
                        keys: Sequence[str] = ("category", "sub_category"), **kw) -> DataFrame:
    """Worst-k (category, sub-category) that lose money."""
    return top_losses(df, keys, k, **kw)


def discount_profit_corr(df: DataFrame, by: str = "category", discount: str = "discount",
                         profit: str = "profit") -> DataFrame:
    """Pearson correlation of discount and profit, overall and per ``by`` (A10).

    One pass with two grouping sets; NaN (not an error) for constant input.
    """
    gid = F.grouping_id(F.col(by))
    agg = df.groupingSets([[], [F.col(by)]], by).agg(
        pearson(discount, profit).alias("corr_discount_profit"), gid.alias("_gid"),
        F.count(F.lit(1)).alias("n_rows"))
    return agg.where((F.col("_gid") == 1) | F.col(by).isNotNull()).select(
        F.when(F.col("_gid") == 1, F.lit("overall")).otherwise(F.lit(by)).alias("scope"),
        by, "corr_discount_profit", "n_rows")


def best_by(df: DataFrame, key: str, measure: str = "sales") -> DataFrame:
    """The key with the largest total ``measure``; ties go to the smallest key.

    Empty input gives an empty result instead of an error.
    """
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(measure).alias(measure))
    return agg.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(1)


def best_region(df: DataFrame, key: str = "region", measure: str = "sales") -> DataFrame:
    return best_by(df, key, measure)


def best_category(df: DataFrame, key: str = "category", measure: str = "sales") -> DataFrame:
    return best_by(df, key, measure)
