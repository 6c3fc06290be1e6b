"""Monthly series, gap filling and forecasts.

The only large step is the first monthly aggregation (partial aggregate per task, then
one shuffle of ``series x months`` rows).  Everything after it works on that small
table: per-series bounds, a month spine built with ``explode(sequence(...))`` (no cross
join), regressions as grouped aggregates, and horizons generated by ``explode``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.operators.combine import attach, side_by_side
from salescope.session import materialize

# Horizon and history length of the reference's forecast step, and the
# two-sided 80 % normal quantile used for the interval.
HORIZON = 6
HISTORY_MONTHS = 12
Z80 = 1.2815515655446004
# pseudo-observations of 0 that shrink each calendar month's season: a month seen once keeps
# half of its residual, one seen ten times ten elevenths
SEASON_PRIOR = 1.0


# Fixed value: month 0 of the regression's time axis (January 2000).  Counting months
# from a nearby epoch instead of from year 0 keeps t small, which keeps the covariance
# sums well conditioned (with t near 24,000, t^2 costs about eight digits).
EPOCH_YEAR = 2000


def _month_index(ds: Column) -> Column:
    return (F.year(ds) - EPOCH_YEAR) * 12 + F.month(ds) - 1


def _keys_not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def monthly_sums(df: DataFrame, date: str = "order_date", value: str = "sales",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` per (keys, month end); rows with a NULL date or key are dropped."""
    keys = list(keys)
    return (df.where(F.col(date).isNotNull() & _keys_not_null(keys))
            .groupBy(*keys, F.last_day(F.col(date)).alias("ds"))
            .agg(F.sum(value).alias("y")))


def gap_fill(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every month between a series' first and last month; missing months get 0."""
    keys = list(keys)
    # every month fills the gap up to the next one: the monthly table is read once, without a join
    following = F.lead("ds").over(Window.partitionBy(*keys).orderBy("ds"))
    until = F.coalesce(F.add_months(F.trunc("_next", "month"), -1), F.trunc("ds", "month"))
    spans = monthly.withColumn("_next", following).select(
        *keys, F.col("ds").alias("_ds"), "y",
        F.explode(F.sequence(F.trunc("ds", "month"), until, F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    known = F.when(F.last_day("_m") == F.col("_ds"), F.col("y"))
    return spans.select(*keys, F.last_day("_m").alias("ds"), F.coalesce(known, F.lit(0.0)).alias("y"))


def monthly_series(df: DataFrame, date: str = "order_date", value: str = "sales",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Gap-filled monthly series ``(keys..., ds date, y double)`` (A12 + F1)."""
    return gap_fill(monthly_sums(df, date, value, keys), keys)


def last_n(series: DataFrame, n: int = HISTORY_MONTHS, keys: Sequence[str] = (),
           order_col: str = "ds") -> DataFrame:
    """Last ``n`` rows of each series by ``order_col`` (F2, K3).

    One series: a global top-n (TakeOrderedAndProject).  Many series: ``row_number``
    partitioned by the keys, which Spark plans with a WindowGroupLimit on both sides of
    the exchange, so at most n rows per series and task are shuffled.
    """
    keys = list(keys)
    if not keys:
        return series.orderBy(F.col(order_col).desc()).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def trend_season_model(series: DataFrame, keys: Sequence[str] = (),
                       season_prior: float = SEASON_PRIOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit y = a + b*t + season[calendar month] per series.

    Returns ``(params, season, history)``: params has ``keys, a, b, n, last_t, last_ds, sd``;
    season has ``keys, mo, season``; history is the fitted series, written once.  The season is
    the residual's sum per calendar month over its count plus ``season_prior``, so it shrinks
    smoothly with fewer years; ``sd`` is the sample deviation of the remaining residual (0 for
    a single month).
    """
    keys = list(keys)
    # series x months rows, read by four branches below: materialise once
    s = materialize(series.select(*keys, "ds", "y", _month_index(F.col("ds")).alias("t"),
                                  F.month("ds").alias("mo")))
    lin = s.groupBy(*keys).agg(
        F.regr_intercept("y", "t").alias("a"), F.regr_slope("y", "t").alias("b"),
        F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"), F.max("ds").alias("last_ds"))
    lin = lin.select(*keys, F.coalesce("a", F.lit(0.0)).alias("a"),
                     F.coalesce("b", F.lit(0.0)).alias("b"), "n", "last_t", "last_ds")
    r = attach(s, lin, ["a", "b", "n"], keys)
    r = r.select(*keys, "mo", "n", (F.col("y") - (F.col("a") + F.col("b") * F.col("t"))).alias("r"))
    season = r.groupBy(*keys, "mo").agg(
        (F.sum("r") / (F.count("r") + F.lit(season_prior))).alias("season"))
    rs = r.join(season, keys + ["mo"])
    sd = rs.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(F.col("r") - F.col("season")), F.lit(0.0)).alias("sd"))
    params = lin.join(sd, keys) if keys else side_by_side(lin, sd)
    return params, season, s


Model = tuple[DataFrame, DataFrame, DataFrame]


def forecast_trend_season(series: DataFrame | None, keys: Sequence[str] = (), horizon: int = HORIZON,
                          z: float = Z80, model: Model | None = None) -> DataFrame:
    """Point forecast and interval for the next ``horizon`` months (F3 + F4).

    Output: ``keys..., ds date, yhat, yhat_lower, yhat_upper``.  Horizons come from
    ``explode(sequence(1, horizon))`` on the one-row-per-series parameters.  ``model`` is a
    fit to reuse (then ``series`` is not read).
    """
    keys = list(keys)
    params, season, _ = model or trend_season_model(series, keys)
    fut = params.select(*keys, "a", "b", "sd", "last_t", "last_ds",
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    fut = fut.select(*keys, "a", "b", "sd",
                     F.last_day(F.add_months("last_ds", F.col("h"))).alias("ds"),
                     (F.col("last_t") + F.col("h")).alias("t"))
    fut = fut.withColumn("mo", F.month("ds"))
    fut = fut.join(season, keys + ["mo"], "left")
    yhat = F.col("a") + F.col("b") * F.col("t") + F.coalesce(F.col("season"), F.lit(0.0))
    return fut.select(*keys, "ds", yhat.alias("yhat"),
                      (yhat - F.lit(z) * F.col("sd")).alias("yhat_lower"),
                      (yhat + F.lit(z) * F.col("sd")).alias("yhat_upper"))


def forecast_fitted(series: DataFrame | None, keys: Sequence[str] = (), model: Model | None = None) -> DataFrame:
    """The fitted line over the history, next to the actuals."""
    keys = list(keys)
    params, season, s = model or trend_season_model(series, keys)
    s = attach(s, params, ["a", "b"], keys)
    s = s.join(season, keys + ["mo"], "left")
    yhat = F.col("a") + F.col("b") * F.col("t") + F.coalesce(F.col("season"), F.lit(0.0))
    return s.select(*keys, "ds", "y", yhat.alias("yhat"))


def forecast_summary(forecast: DataFrame, params: DataFrame | None = None,
                     keys: Sequence[str] = (), flat: float = 0.0) -> DataFrame:
    """Best and worst forecast month and the direction of the trend, per series.

    Ties go to the earliest month.  Direction is the sign of the fitted slope when
    ``params`` is given, else of last-minus-first forecast.
    """
    keys = list(keys)
    agg = forecast.groupBy(*keys).agg(
        F.min_by("ds", F.struct((-F.col("yhat")).alias("k"), F.col("ds").alias("d"))).alias("best_month"),
        F.max("yhat").alias("best_yhat"),
        F.min_by("ds", F.struct(F.col("yhat").alias("k"), F.col("ds").alias("d"))).alias("worst_month"),
        F.min("yhat").alias("worst_yhat"),
        (F.max_by("yhat", "ds") - F.min_by("yhat", "ds")).alias("_delta"))
    if params is not None:
        slope = params.select(*keys, F.col("b").alias("slope"))
        agg = agg.join(slope, keys) if keys else side_by_side(agg, slope)
        sign = F.col("slope")
    else:
        agg = agg.withColumn("slope", F.col("_delta"))
        sign = F.col("_delta")
    direction = (F.when(sign > flat, F.lit("increasing"))
                 .when(sign < -flat, F.lit("decreasing")).otherwise(F.lit("stable")))
    return agg.select(*keys, "best_month", "best_yhat", "worst_month", "worst_yhat",
                      direction.alias("direction"), "slope")
