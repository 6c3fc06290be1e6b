import math

import pytest

from salescope.functions.cleaning import NA_TOKENS, na_to_null, parse_mixed_date, py_strip, to_number
from salescope.sources.csv import clean_sales, read_sales_csv


def test_na_tokens_in_string_columns(spark):
    df = spark.createDataFrame([(v,) for v in ["NA", "N/A", "", "null", "None", "-", "East"]], "r string")
    got = [r[0] for r in df.select(na_to_null("r")).collect()]
    assert [g for g in got if g is not None] == ["-", "East"]
    assert len(NA_TOKENS) == 19


def test_numeric_coercion_defaults_to_zero(spark):
    vals = [" 12 ", "1e3", "1,234", "1.0f", "$5", "inf", "nan", "1_000", "0x10", "true", "12%", None,
            "7e866", "-Infinity"]
    want = [12.0, 1000.0, 0.0, 0.0, 0.0, math.inf, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -math.inf]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(to_number("x")).collect()]
    assert got == want


def test_mixed_dates(spark):
    df = spark.createDataFrame([("2/13/2020",), ("13/2/2020",), ("2020-02-13",), (None,)], "d string")
    got = [r[0] for r in df.select(parse_mixed_date("d")).collect()]
    assert [str(g.date()) if g else None for g in got] == ["2020-02-13"] * 3 + [None]


def test_bad_date_strict_fails_lenient_nulls(spark):
    df = spark.createDataFrame([("foo",)], "d string")
    assert df.select(parse_mixed_date("d", strict=False)).collect()[0][0] is None
    with pytest.raises(Exception):
        df.select(parse_mixed_date("d", strict=True)).collect()


def test_python_strip(spark):
    df = spark.createDataFrame([("\t  hi there \n　",), ("   ",)], "t string")
    assert [r[0] for r in df.select(py_strip("t")).collect()] == ["hi there", ""]


def test_csv_latin1_quotes_and_header(spark, tmpdir_path):
    path = f"{tmpdir_path}/sales.csv"
    body = ('Order Date, Region ,Category,Sub-Category,Segment,Product Name,Sales,Discount,Profit\n'
            '1/15/2020,Caf\xe9,"Furn, ""x""",Tables,Consumer,"Desk ""Pro""",100,0.2,-5\n'
            '2/1/2020,NA,Tech,Phones,Corporate,Phone,bad,,12\n')
    with open(path, "wb") as f:
        f.write(body.encode("latin-1"))
    raw = read_sales_csv(spark, path)
    assert "Region" in raw.columns
    clean = clean_sales(raw)
    got = clean.orderBy("order_date").collect()
    assert got[0]["region"] == "Caf\xe9"
    assert got[0]["category"] == 'Furn, "x"'
    assert got[0]["product_name"] == 'Desk "Pro"'
    assert (got[0]["sales"], got[0]["discount"], got[0]["profit"]) == (100.0, 0.2, -5.0)
    assert got[1]["region"] is None
    assert (got[1]["sales"], got[1]["discount"]) == (0.0, 0.0)
