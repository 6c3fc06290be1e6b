"""Presentation rounding shared by registered queries and their SQL oracles.

Operators return full-precision doubles.  Registered queries round beyond the data's
own decimal places so that two engines summing in different orders print the same
value: sums of 2-decimal sales to 2, sums of 4-decimal profits to 4, ratios to 6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Decimals per output column name.
ROUNDING = {
    "sales": 2, "total_sales": 2, "y": 2, "sales_total": 2,
    "profit": 4, "total_profit": 4,
    "margin": 6, "overall_margin": 6, "discount": 6, "avg_discount": 6,
    "corr_discount_profit": 6,
    # forecasts are money: 2 decimals, like sales
    "yhat": 2, "yhat_lower": 2, "yhat_upper": 2, "slope": 6, "intercept": 2,
    "d2": 6, "weight": 6,
}


def present(df: DataFrame, rounding: dict[str, int] | None = None) -> DataFrame:
    rules = rounding or ROUNDING
    return df.select(*[
        F.round(F.col(c), rules[c]).alias(c) if c in rules else F.col(c) for c in df.columns
    ])
