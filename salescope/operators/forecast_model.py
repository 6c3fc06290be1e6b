"""Many-series forecast with change points and yearly Fourier terms.

Spark gathers each gap-filled monthly series -- at most a few hundred monthly rows, already
aggregated -- into one row and solves its normal equations there, in column expressions (sums of
products, Cholesky factor, two substitutions).  Scale is in the number of series, which Spark spreads
over tasks; no row ever holds raw order lines.  :func:`fit_predict` is the same fit in numpy, for one
series.

Model (the additive design published by Taylor & Letham, 2018, fitted as one penalised
least-squares problem instead of by sampling):

  y(t) = k + m*t + sum_j delta_j * max(0, t - s_j) + sum_{n=1..N} a_n sin(2 pi n d/365.25)
                                                   + b_n cos(2 pi n d/365.25)

with ``t`` the history scaled to [0, 1], up to 25 change points ``s_j`` evenly spaced
over the first 80 % of the history, N = 10 yearly pairs, ridge penalties on the change
points and the seasonal terms, and an 80 % interval ``yhat +/- z * sd(residual)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.session import materialize

# Model defaults.
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
FOURIER_ORDER = 10
YEAR_DAYS = 365.25
CHANGEPOINT_PENALTY = 4.0
SEASON_PENALTY = 1e-4
Z80 = 1.2815515655446004


def _design(days: np.ndarray, t: np.ndarray, cps: np.ndarray, order: int) -> np.ndarray:
    cols = [np.ones_like(t), t]
    cols += [np.maximum(0.0, t - s) for s in cps]
    ang = 2.0 * np.pi * days[:, None] * np.arange(1, order + 1)[None, :] / YEAR_DAYS
    return np.column_stack(cols + [np.sin(ang), np.cos(ang)])


def fit_predict(ds: pd.Series, y: pd.Series, horizon: int, z: float = Z80,
                include_history: bool = False) -> pd.DataFrame:
    """Fit one monthly series and predict ``horizon`` month ends after its last month."""
    order_idx = np.argsort(pd.to_datetime(ds).values)
    ds = pd.to_datetime(ds).iloc[order_idx].reset_index(drop=True)
    yv = np.asarray(y, dtype="float64")[order_idx]
    n = len(yv)
    future = pd.date_range(ds.iloc[-1] + pd.offsets.MonthEnd(1), periods=horizon, freq="ME")
    all_ds = pd.DatetimeIndex(list(ds) + list(future))
    day0 = ds.iloc[0]
    days = np.asarray((all_ds - day0).days, dtype="float64")
    span = max(days[n - 1], 1.0)
    t = days / span
    n_cp = int(min(N_CHANGEPOINTS, np.floor(CHANGEPOINT_RANGE * (n - 1))))
    cps = t[np.linspace(0, np.floor(CHANGEPOINT_RANGE * (n - 1)), n_cp + 2).astype(int)[1:-1]] \
        if n_cp > 0 else np.array([])
    # the penalty, not the length of the series, decides how much season a short history shows
    x = _design(days, t, cps, FOURIER_ORDER)
    scale = float(np.max(np.abs(yv))) or 1.0
    penalty = np.zeros(x.shape[1])
    penalty[2:2 + len(cps)] = CHANGEPOINT_PENALTY
    penalty[2 + len(cps):] = SEASON_PENALTY
    xh = x[:n]
    lhs = xh.T @ xh + np.diag(penalty) + 1e-9 * np.eye(x.shape[1])
    beta = np.linalg.solve(lhs, xh.T @ (yv / scale))
    fit = x @ beta * scale
    resid = yv - fit[:n]
    sd = float(np.std(resid, ddof=1)) if n > 1 else 0.0
    out = pd.DataFrame({"ds": all_ds.date, "yhat": fit, "yhat_lower": fit - z * sd,
                        "yhat_upper": fit + z * sd})
    return out if include_history else out.iloc[n:].reset_index(drop=True)


# --------------------------------------------------------------------------- the same fit on Spark

def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression used inside a lambda is not shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _columns(days: Column, span: Column, points: Column, order: int) -> Column:
    """The design, one array per column: ones, time, hinges, sines, cosines."""
    angle = 2.0 * math.pi / YEAR_DAYS
    waves = F.sequence(F.lit(1), F.lit(order))
    return F.concat(
        F.array(F.transform(days, lambda d: F.lit(1.0)), F.transform(days, lambda d: d / span)),
        F.transform(points, lambda s: F.transform(days, lambda d: F.greatest(F.lit(0.0), d / span - s))),
        F.transform(waves, lambda n: F.transform(days, lambda d: F.sin(d * n * F.lit(angle)))),
        F.transform(waves, lambda n: F.transform(days, lambda d: F.cos(d * n * F.lit(angle)))))


def _cholesky(m: Column) -> Column:
    """Lower factor of a symmetric positive definite matrix given by the rows of its lower triangle."""
    def row(low: Column, own: Column) -> Column:
        # entries before the diagonal, left to right, then the diagonal
        before = F.aggregate(F.slice(low, F.lit(1), F.size(own) - 1), F.array().cast("array<double>"), lambda r, l: F.concat(
            r, F.array((F.get(own, F.size(r)) - _dot(r, F.slice(l, F.lit(1), F.size(r)))) / F.get(l, F.size(r)))))
        return _let(before, lambda r: F.concat(r, F.array(F.sqrt(F.get(own, F.size(own) - 1) - _dot(r, r)))))
    return F.aggregate(m, F.array().cast("array<array<double>>"), lambda low, own: F.concat(low, F.array(row(low, own))))


def _solve(low: Column, rhs: Column) -> Column:
    """x with (low low') x = rhs, by forward and backward substitution."""
    forward = F.aggregate(low, F.array().cast("array<double>"), lambda z, l: F.concat(
        z, F.array((F.get(rhs, F.size(z)) - _dot(F.slice(l, F.lit(1), F.size(z)), z)) / F.get(l, F.size(z)))))
    size = F.size(low)

    def back(z: Column) -> Column:
        # from the last unknown up; the unknowns found so far stand in order
        def step(x: Column, i: Column) -> Column:
            below = F.transform(F.slice(low, i + 2, size), lambda l: F.get(l, i))
            return F.concat(F.array((F.get(z, i) - _dot(below, x)) / F.get(F.get(low, i), i)), x)
        return F.aggregate(F.reverse(F.sequence(F.lit(0), size - 1)), F.array().cast("array<double>"), step)
    return _let(forward, back)


def _fitted(days: Column, ys: Column, all_days: Column) -> Column:
    """Fitted values at ``all_days`` (history first) of the model estimated on ``days`` and ``ys``."""
    n = F.size(days)
    span = F.greatest(F.element_at(days, -1), F.lit(1.0))
    last = F.floor(F.lit(CHANGEPOINT_RANGE) * (n - 1)).cast("int")
    n_cp = F.least(F.lit(N_CHANGEPOINTS), last)
    spots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(N_CHANGEPOINTS)), lambda i: F.when((i > 0) & (i <= n_cp), i)), lambda i: i.isNotNull())
    points = F.transform(spots, lambda i: F.get(days, F.floor(i * (last / (n_cp + 1.0))).cast("int")) / span)
    scale = F.array_max(F.transform(ys, lambda y: F.abs(y)))
    scale = F.when(scale > 0, scale).otherwise(F.lit(1.0))

    def estimate(x: Column) -> Column:
        cols, points, scale = x["cols"], x["points"], x["scale"]
        hinges = F.size(points)
        penalty = lambda i: F.lit(1e-9) + F.when(i < 2, 0.0).when(i < 2 + hinges, CHANGEPOINT_PENALTY).otherwise(SEASON_PENALTY)
        # sums of products over the history: the lower triangle, penalties on its diagonal
        seen = F.transform(cols, lambda c: F.slice(c, F.lit(1), n))
        normal = F.transform(seen, lambda c, i: F.transform(F.slice(seen, F.lit(1), i + 1), lambda b, j: _dot(c, b) + F.when(i == j, penalty(i)).otherwise(0.0)))
        rhs = F.transform(seen, lambda c: _dot(c, F.transform(ys, lambda y: y / scale)))
        beta = _let(normal, lambda m: _let(_cholesky(m), lambda low: _let(rhs, lambda r: _solve(low, r))))
        return _let(beta, lambda b: F.transform(all_days, lambda d, t: scale * F.aggregate(
            F.zip_with(cols, b, lambda c, w: F.get(c, t) * w), F.lit(0.0), lambda s, v: s + v)))

    parts = F.struct(_columns(all_days, span, points, FOURIER_ORDER).alias("cols"), points.alias("points"), scale.alias("scale"))
    return _let(parts, estimate)


def forecast_fourier(series: DataFrame, keys: Sequence[str] = (), horizon: int = 6,
                     z: float = Z80, include_history: bool = False) -> DataFrame:
    """Per-series forecast by normal equations in column expressions.

    ``series`` is a gap-filled monthly table ``(keys..., ds date, y double)``; a series is one row of
    months, a few hundred numbers.  Its design's sums of products are factored and solved where the row
    is: no Python worker, and no shuffle but the one that gathers a series' months.
    Output: ``keys..., ds date, yhat, yhat_lower, yhat_upper``.
    """
    keys = list(keys)
    added = not keys
    if added:
        series = series.withColumn("_series", F.lit(0))
        keys = ["_series"]
    months = (series.where(F.col("y").isNotNull() & F.col("ds").isNotNull()).groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct(F.col("ds").cast("date").alias("ds"), F.col("y").cast("double").alias("y")))).alias("m")))
    last = F.element_at("m", -1)["ds"]
    # the first month end after the last month
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.last_day(F.add_months(last, i - F.when(last == F.last_day(last), 0).otherwise(1))))
    dates = months.select(*keys, F.transform("m", lambda x: x["y"]).alias("ys"),
                          F.concat(F.transform("m", lambda x: x["ds"]), ahead).alias("all_ds")).repartition(*keys)
    days = F.transform("all_ds", lambda d: F.date_diff(d, F.get("all_ds", F.lit(0))).cast("double"))
    n = F.size("ys")
    timed = dates.select(*keys, "ys", "all_ds", days.alias("all_days"))
    fit = timed.withColumn("fit", _fitted(F.slice("all_days", F.lit(1), n), F.col("ys"), F.col("all_days")))
    fit = materialize(fit.select(*keys, "ys", "all_ds", "fit"))
    resid = F.zip_with("ys", F.slice("fit", F.lit(1), n), lambda y, f: y - f)
    mean = lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v) / n
    spread = _let(resid, lambda r: _let(mean(r), lambda m: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.greatest(n - 1, F.lit(1)))))
    rows = fit.select(*keys, n.alias("n"), spread.alias("sd"), F.posexplode(F.arrays_zip(F.col("all_ds").alias("ds"), F.col("fit").alias("yhat"))).alias("pos", "p"))
    if not include_history:
        rows = rows.where(F.col("pos") >= F.col("n"))
    yhat, half = F.col("p.yhat"), F.lit(z) * F.col("sd")
    out = rows.select(*keys, F.col("p.ds").alias("ds"), yhat.alias("yhat"), (yhat - half).alias("yhat_lower"), (yhat + half).alias("yhat_upper"))
    return out.drop("_series") if added else out
