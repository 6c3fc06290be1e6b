"""One key holding a third (or more) of all rows: results stay exact and the plans keep
the hot key from reaching a single reducer in full."""

import datetime as dt

import numpy as np
import pandas as pd

from salescope.operators import kpi
from salescope.sources.catalog import first_per_key
from salescope.sources.partitioning import dimension_join


def _skewed_sales(spark, n=30_000):
    rng = np.random.default_rng(7)
    hot = rng.random(n) < 0.5                      # half of all rows in one region
    pdf = pd.DataFrame({
        "order_date": [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 700, n)],
        "region": np.where(hot, "HOT", rng.choice(["A", "B", "C"], n)),
        "category": rng.choice(["x", "y"], n),
        "sub_category": np.where(rng.random(n) < 0.34, "hot-sub", rng.choice(["s1", "s2", "s3"], n)),
        "segment": rng.choice(["g1", "g2"], n),
        "product_name": rng.choice([f"p{i}" for i in range(50)], n),
        "sales": rng.integers(1, 10_000, n) / 100.0,
        "discount": rng.integers(0, 30, n) / 100.0,
    })
    pdf["profit"] = pdf["sales"] * (0.2 - pdf["discount"])
    return pdf, spark.createDataFrame(pdf).repartition(8)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_aggregates_exact_and_partial_before_shuffle(spark):
    pdf, df = _skewed_sales(spark)
    got = {r["region"]: r for r in kpi.kpi_region(df).collect()}
    want = pdf.groupby("region")[["sales", "profit"]].sum()
    for region, row in want.iterrows():
        assert abs(got[region]["sales"] - row["sales"]) < 1e-6
        assert abs(got[region]["profit"] - row["profit"]) < 1e-6
    g = kpi.kpi_grouping_sets(df)
    g.collect()
    plan = _plan(g)
    # map-side partial aggregate sits below the exchange
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")


def test_hot_key_first_row_uses_partial_group_limit(spark):
    rows = [(1 if i % 3 else i, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(9000)]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz").repartition(8)
    first = first_per_key(ev, ["user_id"], ["ts", "event_id"])
    got = {r["user_id"]: r["event_id"] for r in first.collect()}
    assert got[1] == 1 and len(got) == 1 + len({i for i in range(9000) if i % 3 == 0})
    plan = _plan(first)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_join_key_with_sort_merge_join(spark):
    fact = spark.createDataFrame([(0 if i % 3 == 0 else i % 500, float(i)) for i in range(6000)],
                                 "k long, v double").repartition(8)
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(500)], "k long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = dimension_join(fact, dim, "k", max_rows=10)
        assert j.count() == 6000
        assert "SortMergeJoin" in _plan(j)
        want = sum(1 for i in range(6000) if (0 if i % 3 == 0 else i % 500) == 0)
        assert j.where("k = 0").count() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
