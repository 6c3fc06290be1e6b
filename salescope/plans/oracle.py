"""DuckDB SQL oracles for the registered queries (views of the driver's tables exist)."""

from __future__ import annotations

SALES_CTE = """
WITH sales AS (
  SELECT o.o_orderdate AS order_date, r.r_name AS region, p.p_type AS category,
         p.p_brand AS sub_category, c.c_mktsegment AS segment, p.p_name AS product_name,
         l.l_extendedprice AS sales, l.l_discount + 0.0 AS discount,
         l.l_extendedprice * (1 - l.l_discount)
           - 2.08::DOUBLE * l.l_quantity * p.p_retailprice AS profit
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)
"""


def _margin(p: str = "sum(profit)", s: str = "sum(sales)") -> str:
    return f"CASE WHEN {s} > 0 THEN {p} / {s} * 100.0 ELSE 0.0 END"


_KPI_COLS = f"""round(sum(sales), 2) AS sales, round(sum(profit), 4) AS profit,
  round({_margin()}, 6) AS margin"""
_KPI_COLS_D = _KPI_COLS + ", round((sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0, 6) AS discount"

ORACLE: dict[str, str] = {}

ORACLE["kpi_overall"] = SALES_CTE + f"""
SELECT round(coalesce(sum(sales), 0), 2) AS total_sales,
       round(coalesce(sum(profit), 0), 4) AS total_profit,
       round({_margin('coalesce(sum(profit),0)', 'coalesce(sum(sales),0)')}, 6) AS overall_margin,
       round((sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0, 6) AS avg_discount
FROM sales"""

ORACLE["kpi_region"] = SALES_CTE + f"""
SELECT region, {_KPI_COLS} FROM sales WHERE region IS NOT NULL GROUP BY region"""

ORACLE["kpi_category"] = SALES_CTE + f"""
SELECT category, {_KPI_COLS_D} FROM sales WHERE category IS NOT NULL GROUP BY category"""

ORACLE["kpi_subcategory"] = SALES_CTE + f"""
SELECT category, sub_category, {_KPI_COLS_D} FROM sales
WHERE category IS NOT NULL AND sub_category IS NOT NULL GROUP BY category, sub_category"""

ORACLE["kpi_segment"] = SALES_CTE + f"""
SELECT segment, {_KPI_COLS} FROM sales WHERE segment IS NOT NULL GROUP BY segment"""

ORACLE["kpi_grouping_sets"] = SALES_CTE + f"""
, g AS (
  SELECT region, category, sub_category, segment, product_name,
         sum(sales) AS s, sum(profit) AS p, (sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) AS d,
         grouping(region, category, sub_category, segment, product_name) AS gid
  FROM sales
  GROUP BY GROUPING SETS ((), (region), (category), (category, sub_category), (segment),
                         (sub_category, product_name))
)
SELECT CASE gid WHEN 31 THEN 'overall' WHEN 15 THEN 'region' WHEN 23 THEN 'category'
                WHEN 19 THEN 'subcategory' WHEN 29 THEN 'segment' WHEN 26 THEN 'product' END AS grain,
       region, category, sub_category, segment, product_name,
       round(s, 2) AS sales, round(p, 4) AS profit, round({_margin('p', 's')}, 6) AS margin,
       round(d * 100.0, 6) AS discount
FROM g
WHERE gid = 31 OR (gid = 15 AND region IS NOT NULL) OR (gid = 23 AND category IS NOT NULL)
   OR (gid = 19 AND category IS NOT NULL AND sub_category IS NOT NULL)
   OR (gid = 29 AND segment IS NOT NULL)
   OR (gid = 26 AND sub_category IS NOT NULL AND product_name IS NOT NULL)"""

ORACLE["loss_subcategories"] = SALES_CTE + """
SELECT sub_category, round(sum(profit), 4) AS profit, round(sum(sales), 2) AS sales,
       round((sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0, 6) AS discount
FROM sales WHERE sub_category IS NOT NULL GROUP BY sub_category HAVING sum(profit) < 0
ORDER BY sum(profit), sub_category"""

ORACLE["loss_products"] = SALES_CTE + """
SELECT sub_category, product_name, round(sum(profit), 4) AS profit, round(sum(sales), 2) AS sales,
       round((sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0, 6) AS discount
FROM sales WHERE sub_category IS NOT NULL AND product_name IS NOT NULL
GROUP BY sub_category, product_name HAVING sum(profit) < 0
ORDER BY sum(profit), sub_category, product_name LIMIT 10"""

ORACLE["worst_subcategories"] = SALES_CTE + """
SELECT category, sub_category, round(sum(profit), 4) AS profit, round(sum(sales), 2) AS sales,
       round((sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0, 6) AS discount
FROM sales WHERE category IS NOT NULL AND sub_category IS NOT NULL
GROUP BY category, sub_category HAVING sum(profit) < 0
ORDER BY sum(profit), category, sub_category LIMIT 3"""

ORACLE["discount_profit_corr"] = SALES_CTE + """
SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS scope, category,
       round(coalesce(covar_pop(discount, profit)
             / nullif(stddev_pop(discount) * stddev_pop(profit), 0), 'NaN'::DOUBLE), 6)
         AS corr_discount_profit,
       count(*) AS n_rows
FROM sales GROUP BY GROUPING SETS ((), (category))
HAVING grouping(category) = 1 OR category IS NOT NULL"""

ORACLE["best_region"] = SALES_CTE + """
SELECT region, round(sum(sales), 2) AS sales FROM sales WHERE region IS NOT NULL
GROUP BY region ORDER BY sum(sales) DESC, region LIMIT 1"""

ORACLE["best_category"] = SALES_CTE + """
SELECT category, round(sum(sales), 2) AS sales FROM sales WHERE category IS NOT NULL
GROUP BY category ORDER BY sum(sales) DESC, category LIMIT 1"""


def _monthly_ctes(keys: str = "") -> str:
    """Monthly sums, per-series bounds, month spine and the gap-filled series ``s``."""
    k = f"{keys}, " if keys else ""
    kn = " AND ".join(f"{c.strip()} IS NOT NULL" for c in keys.split(",")) if keys else "TRUE"
    using = f"USING ({keys}, ds)" if keys else "USING (ds)"
    gb = f"GROUP BY {keys}" if keys else ""
    return f"""
, m AS (SELECT {k}last_day(order_date)::DATE AS ds, sum(sales) AS y FROM sales
        WHERE order_date IS NOT NULL AND {kn} GROUP BY ALL),
b AS (SELECT {k}min(ds) AS f, max(ds) AS l FROM m {gb}),
sp AS (SELECT {k}last_day(unnest(generate_series(date_trunc('month', f), date_trunc('month', l),
              INTERVAL 1 MONTH)))::DATE AS ds FROM b),
s AS (SELECT {k}ds, coalesce(m.y, 0.0) AS y, (year(ds) - 2000) * 12 + month(ds) - 1 AS t, month(ds) AS mo
      FROM sp LEFT JOIN m {using})"""


_MODEL_CTES = """,
lin AS (SELECT coalesce(regr_intercept(y, t), 0.0) AS a, coalesce(regr_slope(y, t), 0.0) AS b,
               count(*) AS n, max(t) AS last_t, max(ds) AS last_ds FROM s),
r AS (SELECT s.mo, lin.n, s.y - (lin.a + lin.b * s.t) AS r FROM s, lin),
season AS (SELECT mo, sum(r) / (count(r) + 1.0) AS season FROM r GROUP BY mo),
sdt AS (SELECT coalesce(stddev_samp(r.r - season.season), 0.0) AS sd FROM r JOIN season USING (mo)),
fut AS (SELECT lin.a, lin.b, sdt.sd, last_day(lin.last_ds + to_months(h::INTEGER))::DATE AS ds,
               lin.last_t + h AS t
        FROM lin, sdt, range(1, 7) AS hh(h)),
fc AS (SELECT fut.ds, fut.a + fut.b * fut.t + coalesce(season.season, 0.0) AS yhat, fut.sd
       FROM fut LEFT JOIN season ON month(fut.ds) = season.mo)"""

_Z80 = "1.2815515655446004"

ORACLE["monthly_sales"] = SALES_CTE + _monthly_ctes() + """
SELECT strftime(ds, '%Y-%m-%d') AS ds, round(y, 2) AS y FROM s"""

ORACLE["monthly_gapfill"] = SALES_CTE + _monthly_ctes("sub_category, segment") + """
SELECT sub_category, segment, strftime(ds, '%Y-%m-%d') AS ds, round(y, 2) AS y FROM s"""

ORACLE["history_12m"] = SALES_CTE + _monthly_ctes() + """
SELECT strftime(ds, '%Y-%m-%d') AS ds, round(y, 2) AS y FROM s ORDER BY s.ds DESC LIMIT 12"""

ORACLE["forecast_trend_season"] = SALES_CTE + _monthly_ctes() + _MODEL_CTES + f"""
SELECT strftime(ds, '%Y-%m-%d') AS ds, round(yhat, 2) AS yhat,
       round(yhat - {_Z80} * sd, 2) AS yhat_lower, round(yhat + {_Z80} * sd, 2) AS yhat_upper
FROM fc"""

ORACLE["forecast_fitted"] = SALES_CTE + _monthly_ctes() + _MODEL_CTES + """
SELECT strftime(s.ds, '%Y-%m-%d') AS ds, round(s.y, 2) AS y,
       round(lin.a + lin.b * s.t + coalesce(season.season, 0.0), 2) AS yhat
FROM s CROSS JOIN lin LEFT JOIN season ON s.mo = season.mo"""

ORACLE["forecast_summary"] = SALES_CTE + _monthly_ctes() + _MODEL_CTES + """
SELECT (SELECT strftime(ds, '%Y-%m-%d') FROM fc ORDER BY yhat DESC, ds LIMIT 1) AS best_month,
       round(max(yhat), 2) AS best_yhat,
       (SELECT strftime(ds, '%Y-%m-%d') FROM fc ORDER BY yhat, ds LIMIT 1) AS worst_month,
       round(min(yhat), 2) AS worst_yhat,
       (SELECT CASE WHEN b > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'stable' END
          FROM lin) AS direction,
       (SELECT round(b, 6) FROM lin) AS slope
FROM fc"""


def _model_ctes_keyed(k: str) -> str:
    """Per-key trend + season model and forecast rows ``fc(k, ds, yhat, sd)``."""
    return f""",
lin AS (SELECT {k}, coalesce(regr_intercept(y, t), 0.0) AS a, coalesce(regr_slope(y, t), 0.0) AS b,
               count(*) AS n, max(t) AS last_t, max(ds) AS last_ds FROM s GROUP BY {k}),
r AS (SELECT s.{k}, s.mo, lin.n, s.y - (lin.a + lin.b * s.t) AS r FROM s JOIN lin USING ({k})),
season AS (SELECT {k}, mo, sum(r) / (count(r) + 1.0) AS season
           FROM r GROUP BY {k}, mo),
sdt AS (SELECT {k}, coalesce(stddev_samp(r.r - season.season), 0.0) AS sd
        FROM r JOIN season USING ({k}, mo) GROUP BY {k}),
fut AS (SELECT lin.{k}, lin.a, lin.b, sdt.sd, last_day(lin.last_ds + to_months(h::INTEGER))::DATE AS ds,
               lin.last_t + h AS t
        FROM lin JOIN sdt USING ({k}), range(1, 7) AS hh(h)),
fc AS (SELECT fut.{k}, fut.ds, fut.a + fut.b * fut.t + coalesce(season.season, 0.0) AS yhat, fut.sd
       FROM fut LEFT JOIN season ON fut.{k} = season.{k} AND month(fut.ds) = season.mo)"""


# Change points and yearly waves by ridge regression: products summed row by row, then Gauss-Jordan elimination.
ORACLE["forecast_fourier"] = SALES_CTE.replace("WITH", "WITH RECURSIVE", 1) + _monthly_ctes("sub_category, segment") + f""",
ser AS (SELECT sub_category, segment, list(ds ORDER BY ds) AS h, list(y ORDER BY ds) AS ys, count(*)::INTEGER AS n,
               greatest(max(abs(y)), 0.0) AS top FROM s GROUP BY ALL),
sers AS (SELECT *, CASE WHEN top > 0 THEN top ELSE 1.0 END AS scale, greatest(date_diff('day', h[1], h[n])::DOUBLE, 1.0) AS span,
                floor(0.8::DOUBLE * (n - 1))::INTEGER AS last FROM ser),
pts AS (SELECT *, list_transform(range(1, least(25, last) + 1), lambda i: date_diff('day', h[1], h[floor(i * (last / (least(25, last) + 1.0::DOUBLE)))::INTEGER + 1]) / span) AS cps FROM sers),
obs AS (SELECT sub_category, segment, n, scale, cps, span, h[1] AS d0, unnest(range(1, n + 7)) AS i, h, ys FROM pts),
dated AS (SELECT *, CASE WHEN i <= n THEN h[i] ELSE last_day(h[n] + to_months((i - n)::INTEGER))::DATE END AS ds FROM obs),
x AS (SELECT sub_category, segment, n, scale, i, ds, ys[i] AS y, len(cps) AS hinges,
             [1.0::DOUBLE, date_diff('day', d0, ds) / span]
             || list_transform(cps, lambda c: greatest(0.0, date_diff('day', d0, ds) / span - c))
             || list_transform(range(1, 11), lambda k: sin(2 * pi() * k * date_diff('day', d0, ds) / 365.25))
             || list_transform(range(1, 11), lambda k: cos(2 * pi() * k * date_diff('day', d0, ds) / 365.25)) AS v FROM dated),
places AS (SELECT unnest(range(1, 48)) AS a),
ne AS (SELECT sub_category, segment, a, list(e ORDER BY b) AS r FROM (
         SELECT sub_category, segment, p.a, q.a AS b,
                sum(v[p.a] * v[q.a]) + CASE WHEN p.a <> q.a THEN 0.0 WHEN p.a <= 2 THEN 1e-9 WHEN p.a <= 2 + any_value(hinges) THEN 4.0 + 1e-9 ELSE 1e-4 + 1e-9 END AS e
         FROM x JOIN places p ON p.a <= len(v) JOIN places q ON q.a <= len(v) WHERE i <= n GROUP BY sub_category, segment, p.a, q.a
         UNION ALL
         SELECT sub_category, segment, a, 99 AS b, sum(v[a] * y / scale) AS e FROM x JOIN places ON a <= len(v) WHERE i <= n GROUP BY ALL) GROUP BY ALL),
elim AS (SELECT sub_category, segment, 1 AS j, count(*) AS p, list(r ORDER BY a) AS m FROM ne GROUP BY ALL
         UNION ALL
         SELECT sub_category, segment, j + 1, p, list_transform(m, lambda row, i: CASE WHEN i = j THEN list_transform(row, lambda e: e / row[j])
                ELSE list_transform(row, lambda e, k: e - row[j] * m[j][k] / m[j][j]) END) FROM elim WHERE j <= p),
beta AS (SELECT sub_category, segment, list_transform(m, lambda row: row[p + 1]) AS w FROM elim WHERE j = p + 1),
fit AS (SELECT x.*, scale * list_sum(list_transform(v, lambda e, k: e * w[k])) AS yhat FROM x JOIN beta USING (sub_category, segment)),
sd AS (SELECT sub_category, segment, coalesce(stddev_samp(y - yhat), 0.0) AS sd FROM fit WHERE i <= n GROUP BY ALL)
SELECT sub_category, segment, strftime(ds, '%Y-%m-%d') AS ds, round(yhat, 2) AS yhat,
       round(yhat - {_Z80} * sd, 2) AS yhat_lower, round(yhat + {_Z80} * sd, 2) AS yhat_upper
FROM fit JOIN sd USING (sub_category, segment) WHERE i > n"""
