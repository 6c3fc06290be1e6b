"""Guarded ratios and statistics that stay defined under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def margin_pct(profit: Column | str, sales: Column | str) -> Column:
    """profit / sales * 100 when sales > 0, else 0 (negative sales also give 0)."""
    p, s = _c(profit), _c(sales)
    return F.when(s > 0, p / s * 100.0).otherwise(F.lit(0.0))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation aggregate: NaN for a constant column, one row or no rows.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI on a constant column; covariance over the
    product of standard deviations with ``try_divide`` does not.  Both are single-pass
    mergeable aggregates, so partial aggregation applies.
    """
    cov = F.covar_pop(_c(x), _c(y))
    den = F.stddev_pop(_c(x)) * F.stddev_pop(_c(y))
    return F.coalesce(F.try_divide(cov, F.when(den != 0, den)), F.lit(float("nan")))


def month_end(col: Column | str) -> Column:
    """Month-end date of a date or timestamp."""
    return F.last_day(_c(col))


#: decimal places of a value that are summed exactly, values up to which they are, and bits of the lower half
EXACT_SCALE, EXACT_BELOW, HALF_BITS = 10 ** 8, 9e7, 30


def _parts(col: Column | str) -> dict[str, Column]:
    """What is summed for a mean: a value in whole units of 1 / ``EXACT_SCALE``, in two halves that no sum
    of billions of rows overflows; the rest of it in double; infinities; a count."""
    c = F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))
    inf = F.lit(float("inf"))
    units = F.when(F.abs(c) < EXACT_BELOW, F.rint(c * F.lit(float(EXACT_SCALE)))).otherwise(F.lit(0.0)).cast("bigint")
    rest = F.when(F.abs(c) < inf, c - units / F.lit(float(EXACT_SCALE)))
    # a sum of the infinities alone is an infinity, or NaN if both signs occur
    return {"high": F.shiftright(units, HALF_BITS), "low": units.bitwiseAND(F.lit((1 << HALF_BITS) - 1)), "rest": rest,
            "beyond": F.when(F.abs(c) == inf, c), "n": F.when(c.isNotNull(), F.lit(1).cast("bigint"))}


def mean_parts(col: Column | str, prefix: str) -> list[Column]:
    """Sums ``{prefix}_high, _low, _rest, _beyond, _n`` that :func:`mean_of_parts` turns into a mean; they may be
    taken in two steps (:func:`merged_parts`)."""
    return [F.sum(v).alias(f"{prefix}_{k}") for k, v in _parts(col).items()]


def merged_parts(prefix: str) -> list[Column]:
    return [F.sum(f"{prefix}_{p}").alias(f"{prefix}_{p}") for p in ("high", "low", "rest", "beyond", "n")]


def _mean(high: Column, low: Column, rest: Column, beyond: Column, n: Column) -> Column:
    whole = high.cast("decimal(20,0)") * F.lit(1 << HALF_BITS).cast("decimal(11,0)") + low.cast("decimal(20,0)")
    total = (whole / F.lit(EXACT_SCALE).cast("decimal(9,0)")).cast("double") + rest
    return F.coalesce(beyond, F.try_divide(total, n.cast("double")))


def mean_of_parts(prefix: str) -> Column:
    return _mean(*[F.col(f"{prefix}_{p}") for p in ("high", "low", "rest", "beyond", "n")])


def pearson_parts(x: str, y: str, prefix: str) -> list[Column]:
    """Mergeable moments of the rows in which both are known; extremes tell a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sums = {"n": F.when(both, F.lit(1.0)), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    return [F.sum(v).alias(f"{prefix}_{k}") for k, v in sums.items()] + [
        f(v).alias(f"{prefix}_{n}") for n, f, v in (("x0", F.min, a), ("x1", F.max, a), ("y0", F.min, b), ("y1", F.max, b))]


def merged_pearson(prefix: str) -> list[Column]:
    return [F.sum(f"{prefix}_{k}").alias(f"{prefix}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy")] + [
        f(f"{prefix}_{k}").alias(f"{prefix}_{k}") for k, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))]


def pearson_of_parts(prefix: str) -> Column:
    p = lambda k: F.col(f"{prefix}_{k}")
    cov = p("n") * p("xy") - p("x") * p("y")
    spread = F.sqrt(F.greatest(p("n") * p("xx") - p("x") * p("x"), F.lit(0.0))) * F.sqrt(F.greatest(p("n") * p("yy") - p("y") * p("y"), F.lit(0.0)))
    varies = (p("x0") < p("x1")) & (p("y0") < p("y1"))
    return F.coalesce(F.when(varies, F.try_divide(cov, F.when(spread != 0, spread))), F.lit(float("nan")))


def exact_mean(col: Column | str) -> Column:
    """Mean whose value does not depend on partitioning or summation order.

    Values are summed as whole numbers of their 8th decimal place (exact and associative, so every partial
    aggregation order gives the same total); what that cannot hold -- further digits, or very large
    values -- is summed in double beside it.  A plain double ``avg`` can land on either side of an exact
    rounding tie depending on how rows were split.
    As in pandas, NaN counts as missing, and an infinity decides the mean (both signs: NaN).
    """
    return _mean(*[F.sum(v) for v in _parts(col).values()])
