import duckdb
import pytest

import __spark_entry__ as E
from salescope.sources.fixture import TABLES
from tests.conftest import SF_SMALL


def test_entry_runs_and_has_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["sub_category", "profit", "sales", "discount"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def _norm(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(v)
    return str(v)


def nullable_integers(df, pdf):
    """Integer columns with nulls: pandas holds them as floats on one side and as Int64 on the other."""
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long") and pdf[f.name].isna().any()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s = df.toPandas()
    o = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    for c in nullable_integers(df, s):
        s[c], o[c] = s[c].astype("Int64"), o[c].astype("Int64")
    cols = sorted(s.columns)
    srows = sorted("|".join(_norm(r[c]) for c in cols) for r in s.to_dict("records"))
    orows = sorted("|".join(_norm(r[c]) for c in cols) for r in o.to_dict("records"))
    assert srows == orows
