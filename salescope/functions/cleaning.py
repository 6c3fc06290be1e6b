"""Cleaning expressions: missing-value tokens, numeric coercion, mixed-format dates.

All of these are built-in column expressions, so they run inside whole-stage codegen
and are evaluated lazily on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text tokens a pandas CSV read treats as missing, in every column
# (including string columns).  A plain "-" is NOT in the list and stays a value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Fixed value: the characters Python's str.strip() removes by default (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
                 "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Date layouts tried in order (month first, then day first, then ISO;
# the same with a time of day; then dashes, slashed ISO, month names and compact digits).
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd",
                "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss",
                "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
                "yyyyMMdd"]
# Layouts with a two-digit year: 69 to 99 are of the 1900s.
SHORT_YEAR_FORMATS = ["M/d/yy", "d/M/yy", "M-d-yy", "d-M-yy"]


def py_strip(col: Column | str) -> Column:
    """Remove leading and trailing whitespace as Python's ``str.strip()`` does."""
    c = F.col(col) if isinstance(col, str) else col
    return F.btrim(c, F.lit(PY_WHITESPACE))


def strip_header(df: DataFrame) -> DataFrame:
    """Strip spaces around column names (cell values are left alone)."""
    return df.toDF(*[c.strip() for c in df.columns])


def na_to_null(col: Column | str) -> Column:
    """NULL when the cell is one of the missing-value tokens, else the cell."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~c.isin(NA_TOKENS), c)


def apply_na_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map missing-value tokens to NULL on the given (default: all string) columns."""
    string_cols = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    targets = set(columns) if columns is not None else string_cols
    return df.select(*[
        na_to_null(F.col(f"`{c}`")).alias(c) if c in targets else F.col(f"`{c}`")
        for c in df.columns
    ])


def to_number(col: Column | str) -> Column:
    """Lenient numeric parse with 0 for anything bad or missing.

    Accepts surrounding spaces, exponents and ``inf``/``infinity``; rejects thousands
    separators, currency, percent, underscores, hex and the Java-only ``f``/``d`` suffix.
    NaN becomes 0, and so does a finite literal that overflows (``7e866``), as in pandas.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = F.trim(c.cast("string"))
    java_suffix = s.rlike("[dDfF]$") & ~F.lower(s).rlike("inf$")
    parsed = F.when(java_suffix, F.lit(None).cast("double")).otherwise(s.try_cast("double"))
    inf_literal = F.lower(s).rlike("^[+-]?inf(inity)?$")
    overflow = (F.abs(parsed) == F.lit(float("inf"))) & ~inf_literal
    parsed = F.when(overflow, F.lit(0.0)).otherwise(parsed)
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def _by_formats(s: Column) -> Column:
    """The definition: the first layout that parses the text.  Every failed try costs an exception."""
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS])
    short = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in SHORT_YEAR_FORMATS])
    short = F.when(F.year(short) >= 2069, short - F.expr("INTERVAL 100 YEARS")).otherwise(short)
    return F.coalesce(parsed, short).cast("timestamp_ntz")


def _by_shape(s: Column) -> Column:
    """The same for texts of the usual shapes; NULL for any other text.

    Where separators, letters and colons stand decides the one layout to try, so that a try rarely
    fails; only a first number of 12 or less leaves month-first and day-first open.
    """
    size, slash, dash = F.length(s), F.instr(s, "/"), F.instr(s, "-")
    letters, colon = s.rlike("[A-Za-z]"), F.instr(s, ":")
    # four characters after the last separator, or two
    year_last = F.substring(s, -5, 1).isin("/", "-") & ~F.substring(s, -3, 1).isin("/", "-")
    seconds = F.substring(s, -6, 1) == ":"

    def at(fmt: str) -> Column:
        return F.try_to_timestamp(s, F.lit(fmt))

    def either(month_first: str, day_first: str, sep: str) -> Column:
        first = F.substring_index(s, sep, 1).try_cast("int")
        return F.when(first > 12, at(day_first)).otherwise(F.coalesce(at(month_first), at(day_first)))

    def century(t: Column) -> Column:
        return F.when(F.year(t) >= 2069, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)

    near = F.when(slash > 0, slash).otherwise(dash).between(2, 3)  # one or two characters before the first separator
    lettered = (F.when((size == 19) & (dash == 5), at("yyyy-MM-dd'T'HH:mm:ss"))
                .when(dash > 0, at("d-MMM-yyyy"))
                .when(F.instr(s, ",") == 0, at("d MMM yyyy"))
                .when(F.instr(s, " ") == 4, at("MMM d, yyyy")).otherwise(at("MMMM d, yyyy")))
    timed = (F.when((dash == 5) & (size == 19), at("yyyy-MM-dd HH:mm:ss"))
             .when(near & (slash > 0) & seconds, either("M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "/"))
             .when(near & (slash > 0), either("M/d/yyyy H:mm", "d/M/yyyy H:mm", "/")))
    slashed = (F.when(near & year_last, either("M/d/yyyy", "d/M/yyyy", "/"))
               .when(near, century(either("M/d/yy", "d/M/yy", "/")))
               .when((slash == 5) & (size <= 10), at("yyyy/M/d")))
    dashed = (F.when((dash == 5) & (size == 10), at("yyyy-MM-dd"))
              .when(near & year_last, either("M-d-yyyy", "d-M-yyyy", "-"))
              .when(near, century(either("M-d-yy", "d-M-yy", "-"))))
    return (F.when(letters, lettered).when(colon > 0, timed).when(slash > 0, slashed).when(dash > 0, dashed)
            .when(size == 8, at("yyyyMMdd"))).cast("timestamp_ntz")


def parse_mixed_date(col: Column | str, strict: bool = True) -> Column:
    """Parse month-first, then day-first, then ISO dates.

    With ``strict`` a non-null value that matches no layout raises at run time
    (the whole job fails, as a bad date fails the reference's forecast stage);
    otherwise it becomes NULL.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = F.trim(c.cast("string"))
    # every layout has four digits or more: what has them and is none of the usual shapes is tried layout by layout
    parsed = F.coalesce(_by_shape(s), F.when(F.regexp_count(s, F.lit("[0-9]")) >= 4, _by_formats(s)))
    if not strict:
        return parsed
    bad = s.isNotNull() & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("unparseable date: "), s)).cast("timestamp_ntz")) \
        .otherwise(parsed)
