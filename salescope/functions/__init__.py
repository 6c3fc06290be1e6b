"""Column expressions shared by the operators."""

from salescope.functions.cleaning import (DATE_FORMATS, NA_TOKENS, PY_WHITESPACE, apply_na_tokens,
                                          na_to_null, parse_mixed_date, py_strip, strip_header,
                                          to_number)
from salescope.functions.formats import basename, capitalize, fixed, iso_date, money, pct
from salescope.functions.metrics import exact_mean, margin_pct, month_end, pearson

__all__ = [
    "DATE_FORMATS", "NA_TOKENS", "PY_WHITESPACE", "py_strip", "apply_na_tokens", "na_to_null", "parse_mixed_date",
    "strip_header", "to_number", "basename", "capitalize", "fixed", "iso_date", "money", "pct",
    "exact_mean", "margin_pct", "month_end", "pearson",
]
