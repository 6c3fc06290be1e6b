"""Fact sentences equal the same templates rendered by Python's own number formatting
(``{:,.2f}`` money, ``{:.2f}`` percent) over pandas group-bys of the same table."""

import pandas as pd

from salescope.operators import facts as F_


def _money(x):
    return f"${x:,.2f}"


def _pct(x):
    return f"{x:.2f}"


def _margin(p, s):
    return p / s * 100 if s > 0 else 0


def test_fact_texts_equal_python_rendering(spark):
    from salescope.sources.fixture import sales_view
    from tests.conftest import SF_SMALL
    sales = sales_view(spark, SF_SMALL)
    pdf = sales.toPandas()
    got = {r["fact_id"]: r["text"] for r in F_.facts(sales).collect()}
    want = {}
    ts, tp = pdf["sales"].sum(), pdf["profit"].sum()
    want["overview:totals"] = F_.OVERVIEW_TOTALS.format(sales=_money(ts), profit=_money(tp))
    want["overview:margin"] = F_.OVERVIEW_MARGIN.format(margin=_pct(_margin(tp, ts)))
    for reg, g in pdf.groupby("region"):
        s, p = g["sales"].sum(), g["profit"].sum()
        want[f"region:{reg}"] = F_.REGION.format(region=reg, sales=_money(s), profit=_money(p),
                                                  margin=_pct(_margin(p, s)))
    for cat, g in pdf.groupby("category"):
        s, p, d = g["sales"].sum(), g["profit"].sum(), g["discount"].mean() * 100
        want[f"category:{cat}"] = F_.CATEGORY.format(category=cat, sales=_money(s), profit=_money(p),
                                                      margin=_pct(_margin(p, s)), discount=_pct(d))
    subs = pdf.groupby(["category", "sub_category"]).agg(
        s=("sales", "sum"), p=("profit", "sum"), d=("discount", "mean")).reset_index()
    for r in subs.itertuples():
        want[f"subcategory:{r.category}/{r.sub_category}"] = F_.SUBCATEGORY.format(
            category=r.category, sub_category=r.sub_category, sales=_money(r.s), profit=_money(r.p),
            margin=_pct(_margin(r.p, r.s)), discount=_pct(r.d * 100))
    for seg, g in pdf.groupby("segment"):
        s, p = g["sales"].sum(), g["profit"].sum()
        want[f"segment:{seg}"] = F_.SEGMENT.format(segment=seg, sales=_money(s), profit=_money(p),
                                                    margin=_pct(_margin(p, s)))
    worst = subs.sort_values(["p", "category", "sub_category"]).head(3)
    for r in worst[worst["p"] < 0].itertuples():
        want[f"root_subcategory:{r.category}/{r.sub_category}"] = F_.ROOT_SUBCATEGORY.format(
            sub_category=r.sub_category, profit=_money(r.p), discount=_pct(r.d * 100))
    prods = pdf.groupby(["sub_category", "product_name"]).agg(
        s=("sales", "sum"), p=("profit", "sum"), d=("discount", "mean")).reset_index()
    top = prods.sort_values(["p", "sub_category", "product_name"]).head(15)
    for r in top[top["p"] < 0].itertuples():
        want[f"root_product:{r.sub_category}/{r.product_name}"] = F_.ROOT_PRODUCT.format(
            product_name=r.product_name, sub_category=r.sub_category, profit=_money(r.p),
            sales=_money(r.s), discount=_pct(r.d * 100))
    got_core = {k: v for k, v in got.items() if not k.startswith("correlation:")}
    assert got_core.keys() == want.keys()
    diffs = [(k, got_core[k], want[k]) for k in want if got_core[k] != want[k]]
    assert not diffs, diffs[:3]
    corr = pd.Series(pdf["discount"]).corr(pdf["profit"])
    assert f"{corr:.4f}" in got["correlation:overall"]
