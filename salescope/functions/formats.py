"""Text formats used in facts, summaries and prompts.

``format_number(x, 2)`` rounds the exact binary value half-even and inserts thousands
separators, which is what Python's ``{:,.2f}`` does; ``format_string('%,.2f')`` does
not (it rounds half-up on the decimal text).  The pattern form ``format_number(x, '0.00')``
gives the plain ``{:.2f}`` rendering.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col: Column | str) -> Column:
    """``$1,234.50``; a loss prints as ``$-1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(_c(col), 2))


def fixed(col: Column | str, decimals: int) -> Column:
    """Plain fixed-point text without separators: ``12.35``, ``-0.00``."""
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", _c(col), F.lit(pattern))


def pct(col: Column | str, decimals: int = 2) -> Column:
    """Percent number text (no ``%`` sign; templates add it)."""
    return fixed(col, decimals)


def capitalize(col: Column | str) -> Column:
    """First character upper case, the rest lower case (``initcap`` differs on several words)."""
    c = _c(col)
    return F.concat(F.upper(c.substr(1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def basename(col: Column | str) -> Column:
    """Last path element."""
    return F.element_at(F.split(_c(col), "/"), -1)


def iso_date(col: Column | str) -> Column:
    """``yyyy-MM-dd`` text of a date or timestamp."""
    return F.date_format(_c(col), "yyyy-MM-dd")
