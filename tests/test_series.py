import datetime as dt

import numpy as np
import pandas as pd

from salescope.operators import forecast_model, series


def test_gap_fill_month_ends(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 15), 1.0), (dt.datetime(2020, 4, 2), 2.0),
                                (None, 9.0)], "order_date timestamp_ntz, sales double")
    got = [(str(r["ds"]), r["y"]) for r in series.monthly_series(df).orderBy("ds").collect()]
    assert got == [("2020-01-31", 1.0), ("2020-02-29", 0.0), ("2020-03-31", 0.0), ("2020-04-30", 2.0)]


def test_gap_fill_per_series_and_total(spark):
    rows = [("a", dt.datetime(2020, m, 3), float(m)) for m in (1, 5)] + \
           [("b", dt.datetime(2020, 3, 1), 7.0)]
    df = spark.createDataFrame(rows, "k string, order_date timestamp_ntz, sales double")
    got = series.monthly_series(df, keys=["k"])
    assert got.where("k = 'a'").count() == 5 and got.where("k = 'b'").count() == 1
    assert got.agg({"y": "sum"}).collect()[0][0] == 13.0


def test_trend_season_recovers_line(spark):
    months = pd.date_range("2018-01-31", periods=36, freq="ME")
    y = [100.0 + 10.0 * i for i in range(36)]
    df = spark.createDataFrame(pd.DataFrame({"ds": months.date, "y": y}))
    fc = series.forecast_trend_season(df).orderBy("ds").collect()
    assert len(fc) == 6
    assert [str(r["ds"]) for r in fc][:2] == ["2021-01-31", "2021-02-28"]
    assert abs(fc[0]["yhat"] - 460.0) < 1e-6
    assert abs(fc[0]["yhat_upper"] - fc[0]["yhat"]) < 1e-6


def test_last_n_single_and_many(spark):
    months = pd.date_range("2019-01-31", periods=20, freq="ME")
    pdf = pd.DataFrame({"k": ["a"] * 20 + ["b"] * 20, "ds": list(months.date) * 2, "y": list(range(40))})
    df = spark.createDataFrame(pdf)
    assert series.last_n(df.where("k = 'a'").drop("k"), 12).count() == 12
    assert series.last_n(df, 12, keys=["k"]).count() == 24


def test_fourier_model_recovers_slope_and_season():
    months = pd.date_range("2015-01-31", periods=72, freq="ME")
    t = np.arange(72)
    season = 50.0 * np.sin(2 * np.pi * months.month.values / 12.0)
    y = 1000.0 + 5.0 * t + season
    out = forecast_model.fit_predict(pd.Series(months), pd.Series(y), horizon=6)
    truth = 1000.0 + 5.0 * np.arange(72, 78) + 50.0 * np.sin(
        2 * np.pi * pd.date_range(months[-1] + pd.offsets.MonthEnd(1), periods=6, freq="ME").month.values / 12.0)
    assert len(out) == 6
    assert np.max(np.abs(out["yhat"].values - truth)) < 0.05 * 1000


def test_fourier_many_series(spark):
    months = pd.date_range("2018-01-31", periods=30, freq="ME")
    pdf = pd.DataFrame({"k": ["a"] * 30 + ["b"] * 30, "ds": list(months.date) * 2,
                        "y": list(np.linspace(1, 30, 30)) + list(np.linspace(30, 1, 30))})
    out = forecast_model.forecast_fourier(spark.createDataFrame(pdf), keys=["k"]).collect()
    assert len(out) == 12
    by = {}
    for r in out:
        by.setdefault(r["k"], []).append(r["yhat"])
    assert np.mean(by["a"]) > 25 and np.mean(by["b"]) < 6
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in out)


def test_normal_equations_equal_the_numpy_fit(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, n in [("one", 1), ("two", 2), ("short", 7), ("year", 14), ("long", 81), ("flat", 20), ("longer", 200)]:
        months = pd.date_range("2004-01-31", periods=n, freq="ME")
        y = np.zeros(n) if k == "flat" else 1e5 * (1 + rng.random(n)) + 500.0 * np.arange(n)
        rows += [(k, d.date(), float(v)) for d, v in zip(months, y)]
        want[k] = forecast_model.fit_predict(pd.Series(months), pd.Series(y), horizon=6, include_history=True)
    df = spark.createDataFrame(rows, "k string, ds date, y double").repartition(5)
    got = forecast_model.forecast_fourier(df, keys=["k"], include_history=True).toPandas().sort_values(["k", "ds"])
    for k, w in want.items():
        g = got[got.k == k]
        assert list(g.ds) == list(w.ds)
        for c in ("yhat", "yhat_lower", "yhat_upper"):
            assert np.allclose(g[c], w[c], rtol=1e-6, atol=1e-4), k
    assert forecast_model.forecast_fourier(df.limit(0), keys=["k"]).count() == 0


def test_gap_filled_series_sum_to_total(spark):
    from salescope.operators.kpi import kpi_overall
    from salescope.sources.fixture import sales_view
    from tests.conftest import SF_SMALL
    s = sales_view(spark, SF_SMALL)
    total = kpi_overall(s).collect()[0]["total_sales"]
    one = series.monthly_series(s).agg({"y": "sum"}).collect()[0][0]
    many = series.monthly_series(s, keys=["sub_category", "segment"]).agg({"y": "sum"}).collect()[0][0]
    assert abs(one - total) < 1e-6 * total and abs(many - total) < 1e-6 * total


def test_keyed_forecast_equals_each_series_alone(spark):
    months = pd.date_range("2017-01-31", periods=30, freq="ME")
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["a"] * 30 + ["b"] * 30, "ds": list(months.date) * 2,
                        "y": list(100 + 3 * np.arange(30) + rng.normal(0, 5, 30)) +
                             list(500 - 2 * np.arange(30) + rng.normal(0, 5, 30))})
    df = spark.createDataFrame(pdf)
    keyed = {(r["k"], str(r["ds"])): r["yhat"] for r in series.forecast_trend_season(df, keys=["k"]).collect()}
    for k in ("a", "b"):
        alone = series.forecast_trend_season(df.where(f"k = '{k}'").drop("k")).collect()
        for r in alone:
            assert abs(keyed[(k, str(r["ds"]))] - r["yhat"]) < 1e-6
    summ = series.forecast_summary(series.forecast_trend_season(df, keys=["k"]),
                                   series.trend_season_model(df, keys=["k"])[0], keys=["k"]).collect()
    assert {r["k"]: r["direction"] for r in summ} == {"a": "increasing", "b": "decreasing"}


def test_season_shrinks_smoothly_with_short_histories(spark):
    import datetime as dt
    from salescope.operators import forecast_model
    rows = [(dt.date(2020 + i // 12, i % 12 + 1, 28), 100.0 + 50.0 * (i % 12 == 11)) for i in range(12)]
    year = spark.createDataFrame(rows, "ds date, y double").selectExpr("last_day(ds) AS ds", "y")
    _, season, _ = series.trend_season_model(year)
    assert max(r["season"] for r in season.collect()) > 10
    short = forecast_model.forecast_fourier(year.where("month(ds) <= 11"), include_history=True).collect()
    assert len({round(r["yhat"], 6) for r in short}) > 2


def test_gap_fill_reads_its_input_once(spark):
    df = spark.createDataFrame([("a", "2020-01-15", 1.0), ("a", "2020-04-02", 2.0), ("b", "2020-03-03", 5.0), ("a", None, 9.0)],
                               "k string, d string, sales double").selectExpr("k", "to_date(d) AS order_date", "sales")
    out = series.monthly_series(df, keys=["k"])
    assert sorted((r["k"], str(r["ds"]), r["y"]) for r in out.collect()) == [
        ("a", "2020-01-31", 1.0), ("a", "2020-02-29", 0.0), ("a", "2020-03-31", 0.0), ("a", "2020-04-30", 2.0), ("b", "2020-03-31", 5.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
