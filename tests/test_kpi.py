import math

from pyspark.sql import functions as F

from salescope.operators import kpi

SCHEMA = "region string, category string, sub_category string, segment string, product_name string, " \
         "sales double, profit double, discount double"


def _df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_margin_guard_zero_and_negative_sales(spark):
    df = _df(spark, [("a", "c", "s", "g", "p", 0.0, 5.0, 0.1), ("b", "c", "s", "g", "p", -5.0, 1.0, 0.1)])
    got = {r["region"]: r["margin"] for r in kpi.kpi_region(df).collect()}
    assert got == {"a": 0.0, "b": 0.0}


def test_null_keys_dropped_and_mean_counts_zero(spark):
    df = _df(spark, [(None, "c", "s", "g", "p", 1.0, 1.0, 0.0), ("x", "c", "s", "g", "p", 1.0, 1.0, 0.2)])
    assert [r["region"] for r in kpi.kpi_region(df).collect()] == ["x"]
    cat = kpi.kpi_category(df).collect()[0]
    assert abs(cat["discount"] - 10.0) < 1e-12


def test_constant_correlation_is_nan_not_error(spark):
    df = _df(spark, [("r", "c", "s", "g", "p", 1.0, 1.0, 1.0), ("r", "c", "s", "g", "p", 1.0, 2.0, 1.0)])
    got = kpi.discount_profit_corr(df).collect()
    assert len(got) == 2 and all(math.isnan(r["corr_discount_profit"]) for r in got)


def test_ties_go_to_smallest_key(spark):
    df = _df(spark, [("b", "c", "s", "g", "p", 5.0, 1.0, 0.0), ("a", "c", "s", "g", "p", 5.0, 1.0, 0.0)])
    assert kpi.best_region(df).collect()[0]["region"] == "a"


def test_empty_input(spark):
    df = _df(spark, [])
    o = kpi.kpi_overall(df).collect()[0]
    assert (o["total_sales"], o["total_profit"], o["overall_margin"]) == (0.0, 0.0, 0.0)
    assert o["avg_discount"] is None
    assert kpi.best_region(df).count() == 0


def test_topk_filter_then_limit(spark):
    data = [("r", "c", f"s{i}", "g", f"p{i}", 10.0, float(i - 5), 0.0) for i in range(10)]
    got = kpi.loss_products(_df(spark, data), k=3).collect()
    assert [r["product_name"] for r in got] == ["p0", "p1", "p2"]
    assert kpi.worst_subcategories(_df(spark, data), k=20).count() == 5


def test_grouping_sets_equal_single_groupings(spark):
    from salescope.sources.fixture import sales_view
    from tests.conftest import SF_SMALL
    s = sales_view(spark, SF_SMALL).cache()
    g = kpi.kpi_grouping_sets(s)
    reg = {r["region"]: round(r["sales"], 2) for r in kpi.kpi_region(s).collect()}
    greg = {r["region"]: round(r["sales"], 2) for r in g.where("grain = 'region'").collect()}
    assert reg == greg
    total = kpi.kpi_overall(s).collect()[0]["total_sales"]
    for grain in ["region", "category", "subcategory", "segment", "product"]:
        sub = g.where(F.col("grain") == grain).agg(F.sum("sales")).collect()[0][0]
        assert abs(sub - total) < 1e-6 * total
    s.unpersist()


def test_star_join_plan_at_scale_never_broadcasts_fact(spark):
    """With a tiny broadcast cap (as at 100 TB) big dimensions use sort-merge joins."""
    from salescope.sources.fixture import sales_view
    from tests.conftest import SF_SMALL
    spark.conf.set("salescope.broadcast.maxRows", "30")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sales_view(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("salescope.broadcast.maxRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("BroadcastHashJoin") == 2      # nation-region, customer-geo (25 nations)
    small = sales_view(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in small and "BuildLeft" not in small


def test_exact_mean_of_infinities_nan_and_tiny_values(spark):
    import math

    import pandas as pd

    from salescope.functions.metrics import exact_mean
    inf, nan = float("inf"), float("nan")
    for values in ([inf, 0.0], [-inf, 1.0], [inf, -inf, 1.0], [nan, 1.0, 2.0], [nan], [1e-12, 3e-12], [1e300, 1e300], [0.1] * 10, []):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got, want = df.agg(exact_mean("x").alias("m")).first()["m"], float(pd.Series(values, dtype=float).mean())
        if not values or all(math.isnan(v) for v in values):
            assert got is None
        else:
            assert (math.isnan(got) and math.isnan(want)) or got == want or abs(got - want) <= 1e-12 * abs(want), (values, got, want)
