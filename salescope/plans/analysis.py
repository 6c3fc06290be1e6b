"""Composed stage results: analysis, root cause, forecast.

Each result is one row with nested arrays of records, built from already-aggregated
DataFrames (regions, categories, sub-categories: bounded by the dimensions, not by the
rows) with ``collect_list(struct)`` sorted by key -- the shape the reference returns as
JSON.  ``to_json`` turns it into the API's text form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators import kpi, series, text
from salescope.operators.combine import side_by_side
from salescope.session import materialize


def _records(df: DataFrame, order: list[str], alias: str) -> DataFrame:
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    fields = [F.col(c) for c in df.columns]
    return df.agg(F.array_sort(F.collect_list(F.struct(*keys, *fields)))
                  .alias("_l")).select(
        F.transform("_l", lambda r: F.struct(*[r[c].alias(c) for c in df.columns])).alias(alias))


def analysis_result(sales: DataFrame) -> DataFrame:
    """KPIs plus regional, category and sub-category breakdowns in one row."""
    g = materialize(kpi.kpi_grouping_sets(sales, grains={
        "overall": (), "region": ("region",), "category": ("category",),
        "subcategory": ("category", "sub_category")}))
    overall = g.where(F.col("grain") == "overall").select(
        F.coalesce("sales", F.lit(0.0)).alias("total_sales"),
        F.coalesce("profit", F.lit(0.0)).alias("total_profit"),
        F.col("margin").alias("overall_margin"), F.col("discount").alias("avg_discount"))
    reg = _records(g.where(F.col("grain") == "region").select("region", "sales", "profit", "margin"),
                   ["region"], "regional_analysis")
    cat = _records(g.where(F.col("grain") == "category").select(
        "category", "sales", "profit", "margin", "discount"), ["category"], "category_analysis")
    sub = _records(g.where(F.col("grain") == "subcategory").select(
        "category", F.col("sub_category").alias("subcategory"), "sales", "profit", "margin",
        "discount"), ["category", "subcategory"], "subcategory_analysis")
    return side_by_side(overall, reg, cat, sub)


def root_cause_result(sales: DataFrame, k: int = 10) -> DataFrame:
    """Loss sub-categories, top-k loss products and the discount/profit correlation."""
    subs = _records(kpi.loss_subcategories(sales, sort=False), ["profit", "sub_category"],
                    "loss_subcategories")
    prods = _records(kpi.loss_products(sales, k=k), ["profit", "sub_category", "product_name"],
                     "loss_products")
    corr = kpi.discount_profit_corr(sales).where(F.col("scope") == "overall") \
        .select(F.col("corr_discount_profit").alias("correlation_discount_profit"))
    return side_by_side(subs, prods, corr)


def forecast_result(sales: DataFrame) -> DataFrame:
    """Six predictions and twelve months of history, dates as ``yyyy-MM-dd``."""
    m = materialize(series.monthly_series(sales))
    pred = series.forecast_trend_season(m).select(
        F.date_format("ds", "yyyy-MM-dd").alias("date"), F.col("yhat").alias("forecast"),
        F.col("yhat_lower").alias("lower"), F.col("yhat_upper").alias("upper"))
    hist = series.last_n(m, 12).select(F.date_format("ds", "yyyy-MM-dd").alias("date"),
                                       F.col("y").alias("sales"))
    return side_by_side(_records(pred, ["date"], "predictions"), _records(hist, ["date"], "history"))


def results_json(sales: DataFrame) -> DataFrame:
    """The three results as JSON text, one row each: ``(result, json)``."""
    parts = [("analysis", analysis_result(sales)), ("root_cause", root_cause_result(sales)),
             ("forecast", forecast_result(sales))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("result"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = row if out is None else out.unionByName(row)
    return out


def final_reports(sales: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One executive report per report key (per region, per dataset, ...), or one in all.

    KPIs, loss sub-categories and the forecast are each computed per key in one pass and
    equi-joined on the key.
    """
    keys = list(keys)
    if keys:
        overall = kpi.kpi_by(sales, keys, discount="discount").select(
            *keys, F.col("sales").alias("total_sales"), F.col("profit").alias("total_profit"),
            F.col("margin").alias("overall_margin"), F.col("discount").alias("avg_discount"))
        loss = kpi.kpi_by(sales, keys + ["sub_category"], discount="discount") \
            .where(F.col("profit") < 0)
    else:
        overall = kpi.kpi_overall(sales)
        loss = kpi.loss_subcategories(sales, sort=False)
    monthly = series.monthly_series(sales, keys=keys)
    fc = text.forecast_lines(series.forecast_trend_season(monthly, keys), keys)
    return text.final_report(overall, loss, fc, keys=keys)
