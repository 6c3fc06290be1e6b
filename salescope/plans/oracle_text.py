"""DuckDB SQL oracles for facts, summaries, history, report and plan parsing."""

from __future__ import annotations

from salescope.plans.oracle_grid import _SPACES
from salescope.plans.oracle import _MODEL_CTES, _Z80, ORACLE, SALES_CTE, _model_ctes_keyed, _monthly_ctes


def _money(x: str, d: int) -> str:
    return f"'$' || format('{{:,.2f}}', round({x}, {d}))"


def _fixed(x: str, decimals: int) -> str:
    return f"format('{{:.{decimals}f}}', round({x}, 6))"


_FACT_G = f"""
, g AS (
  SELECT region, category, sub_category, segment, product_name,
         sum(sales) AS s, sum(profit) AS p, (sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0 AS d,
         coalesce(covar_pop(discount, profit) / nullif(stddev_pop(discount) * stddev_pop(profit), 0),
                  'NaN'::DOUBLE) AS c,
         grouping(region, category, sub_category, segment, product_name) AS gid
  FROM sales
  GROUP BY GROUPING SETS ((), (region), (category), (category, sub_category), (segment),
                         (sub_category, product_name))
),
f AS (
  SELECT *, {_money("s", 2)} AS ts, {_money("p", 4)} AS tp,
         {_fixed("CASE WHEN s > 0 THEN p / s * 100.0 ELSE 0.0 END", 2)} AS tm,
         {_fixed("d", 2)} AS td,
         CASE WHEN isnan(c) THEN 'NaN' ELSE {_fixed("c", 4)} END AS tc
  FROM g
)"""

ORACLE["facts"] = SALES_CTE + _FACT_G + """
SELECT 'overview:totals' AS fact_id, 1 AS family,
       'Business Overview: The company has total sales of ' || ts || ' and a total profit of ' || tp || '.' AS text
FROM f WHERE gid = 31
UNION ALL
SELECT 'overview:margin', 1, 'Business Overview: The overall profit margin for the business is ' || tm || '%.'
FROM f WHERE gid = 31
UNION ALL
SELECT 'region:' || region, 2, 'Regional Analysis: Region ''' || region || ''' generated total sales of '
       || ts || ' and a net profit of ' || tp || ' (Profit Margin: ' || tm || '%).'
FROM f WHERE gid = 15 AND region IS NOT NULL
UNION ALL
SELECT 'category:' || category, 3, 'Category Analysis: Category ''' || category || ''' generated sales of '
       || ts || ' and profit of ' || tp || ' (Margin: ' || tm || '%) with an average discount of ' || td || '%.'
FROM f WHERE gid = 23 AND category IS NOT NULL
UNION ALL
SELECT 'subcategory:' || category || '/' || sub_category, 4,
       'Sub-category Analysis: In Category ''' || category || ''', the sub-category ''' || sub_category
       || ''' generated sales of ' || ts || ' and profit of ' || tp || ' (Margin: ' || tm
       || '%) with an average discount of ' || td || '%.'
FROM f WHERE gid = 19 AND category IS NOT NULL AND sub_category IS NOT NULL
UNION ALL
SELECT 'segment:' || segment, 5, 'Customer Segment Analysis: Segment ''' || segment || ''' generated sales of '
       || ts || ' and profit of ' || tp || ' (Margin: ' || tm || '%).'
FROM f WHERE gid = 29 AND segment IS NOT NULL
UNION ALL
SELECT * FROM (
  SELECT 'root_subcategory:' || category || '/' || sub_category, 6,
         'Root Cause: The sub-category ''' || sub_category || ''' is highly unprofitable, generating a net loss of '
         || tp || ' with a high average discount rate of ' || td || '%. This indicates discount erosion.'
  FROM f WHERE gid = 19 AND category IS NOT NULL AND sub_category IS NOT NULL AND p < 0
  ORDER BY p, category, sub_category LIMIT 3)
UNION ALL
SELECT * FROM (
  SELECT 'root_product:' || sub_category || '/' || product_name, 6,
         'Root Cause: Product ''' || product_name || ''' (Sub-category ''' || sub_category
         || ''') is a top loss-maker, causing a net loss of ' || tp || ' on sales of ' || ts
         || ' with an average discount of ' || td || '%.'
  FROM f WHERE gid = 26 AND sub_category IS NOT NULL AND product_name IS NOT NULL AND p < 0
  ORDER BY p, sub_category, product_name LIMIT 15)
UNION ALL
SELECT 'correlation:overall', 7,
       'Root Cause Correlation: Across all sales, the correlation between discount and profit is ' || tc || '.'
FROM f WHERE gid = 31
UNION ALL
SELECT 'correlation:' || category, 7, 'Root Cause Correlation: In Category ''' || category
       || ''', the correlation between discount and profit is ' || tc || '.'
FROM f WHERE gid = 23 AND category IS NOT NULL"""

_LOSS_CTES = """
, subs AS (SELECT sub_category, sum(profit) AS p, sum(sales) AS s, (sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0 AS d
           FROM sales WHERE sub_category IS NOT NULL GROUP BY sub_category HAVING sum(profit) < 0),
prods AS (SELECT sub_category, product_name, sum(profit) AS p, sum(sales) AS s,
                 (sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0 AS d
          FROM sales WHERE sub_category IS NOT NULL AND product_name IS NOT NULL
          GROUP BY sub_category, product_name HAVING sum(profit) < 0
          ORDER BY p, sub_category, product_name LIMIT 5)"""

ORACLE["loss_summary"] = SALES_CTE + _LOSS_CTES + f"""
SELECT coalesce((SELECT string_agg('- ' || sub_category || ': Profit: ' || {_money("p", 4)}
                   || ', Sales: ' || {_money("s", 2)} || ', Avg Discount: ' || {_fixed("d", 1)}
                   || '%' || chr(10), '' ORDER BY p, sub_category) FROM subs), 'None') AS loss_summary,
       coalesce((SELECT string_agg('- ' || product_name || ' (' || sub_category || '): Profit: '
                   || {_money("p", 4)} || ', Sales: ' || {_money("s", 2)}
                   || ', Avg Discount: ' || {_fixed("d", 1)} || '%' || chr(10), ''
                   ORDER BY p, sub_category, product_name) FROM prods), 'None') AS product_summary"""

_FORECAST_TEXT = f"""
, ft AS (SELECT string_agg('- Date: ' || strftime(ds, '%Y-%m-%d') || ', Forecasted Sales: '
                || {_money("yhat", 4)} || ' (Confidence: ' || {_money(f"yhat - {_Z80} * sd", 4)}
                || ' to ' || {_money(f"yhat + {_Z80} * sd", 4)} || ')' || chr(10), '' ORDER BY ds)
                AS forecast_text FROM fc)"""

ORACLE["forecast_lines"] = SALES_CTE + _monthly_ctes() + _MODEL_CTES + _FORECAST_TEXT + """
SELECT forecast_text FROM ft"""

ORACLE["chat_history"] = """
SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text || chr(10),
                           '' ORDER BY turn) AS history
FROM conversations GROUP BY conv_id"""

_MARGIN_SQL = "CASE WHEN ts > 0 THEN tp / ts * 100.0 ELSE 0.0 END"

ORACLE["final_report"] = SALES_CTE + _monthly_ctes() + _MODEL_CTES + _FORECAST_TEXT + _LOSS_CTES + f""",
kpi AS (SELECT coalesce(sum(sales), 0.0) AS ts, coalesce(sum(profit), 0.0) AS tp,
               (sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0 AS ad FROM sales),
summ AS (SELECT chr(10) || '    Business KPIs:' || chr(10) || '    - Total Sales: ' || {_money("ts", 2)}
                || chr(10) || '    - Total Profit: ' || {_money("tp", 4)} || chr(10)
                || '    - Profit Margin: ' || {_fixed(_MARGIN_SQL, 2)}
                || '%' || chr(10) || '    - Average Discount: ' || {_fixed("coalesce(ad, 0.0)", 2)} || '%'
                || chr(10) || '    ' || chr(10)
                || 'Root Cause: Underperforming sub-categories show average discounts like:' || chr(10)
                || coalesce((SELECT string_agg('- ' || sub_category || ': Loss: ' || {_money("p", 4)}
                             || ', Discount: ' || {_fixed("d", 1)} || '%' || chr(10), ''
                             ORDER BY p, sub_category) FROM subs), '') AS summary FROM kpi)
SELECT '# Executive Business Report' || chr(10) || chr(10) || '## 1. System Performance Overview' || chr(10)
       || summary || chr(10) || chr(10) || '## 2. Root Cause Analysis' || chr(10) || 'No details available.'
       || chr(10) || chr(10) || '## 3. Sales Forecasting & Analysis' || chr(10)
       || coalesce((SELECT forecast_text FROM ft), '') || chr(10) || chr(10)
       || '## 4. Strategic Recommendations & Action Plan' || chr(10) || '' || chr(10) AS report
FROM summ"""

_PLAN_CTES = r"""
WITH r AS (SELECT conv_id, turn, trim(text, __WHITESPACE__) AS s
           FROM conversations WHERE role = 'assistant'),
r1 AS (SELECT *, CASE WHEN starts_with(s, '```json') THEN substr(s, 8) ELSE s END AS s1 FROM r),
r2 AS (SELECT *, CASE WHEN ends_with(s1, '```') THEN substr(s1, 1, length(s1) - 3) ELSE s1 END AS s2 FROM r1),
r3 AS (SELECT *, trim(s2, __WHITESPACE__) AS body FROM r2),
r4 AS (SELECT conv_id, turn,
              CASE WHEN starts_with(body, '[') AND ends_with(body, ']') AND json_valid(body)
                        AND json_type(body) = 'ARRAY'
                   THEN from_json(body, '["VARCHAR"]') END AS parsed FROM r3),
p AS (SELECT conv_id, turn, coalesce(parsed, ['analysis', 'root_cause', 'forecast', 'explanation',
              'recommendation']) AS plan, parsed IS NULL AS plan_is_default FROM r4)"""

_PLAN_CTES = _PLAN_CTES.replace("__WHITESPACE__", "'" + _SPACES + "'")

ORACLE["parse_plan"] = _PLAN_CTES + """
SELECT conv_id, turn, array_to_string(plan, ',') AS plan, plan_is_default FROM p"""

ORACLE["resolve_plan"] = _PLAN_CTES + """
SELECT conv_id, turn,
       array_to_string(list_filter(['analysis', 'root_cause', 'forecast', 'explanation', 'recommendation'],
                                   lambda x: list_contains(plan, x)), ',') AS stages
FROM p"""


_MEAN_D = "(sum(round(discount * 100)::BIGINT) / 100.0 / count(discount))"

ORACLE["final_report_by_region"] = SALES_CTE + _monthly_ctes("region") + _model_ctes_keyed("region") + f""",
ft AS (SELECT region, string_agg('- Date: ' || strftime(ds, '%Y-%m-%d') || ', Forecasted Sales: '
                || {_money("yhat", 4)} || ' (Confidence: ' || {_money(f"yhat - {_Z80} * sd", 4)}
                || ' to ' || {_money(f"yhat + {_Z80} * sd", 4)} || ')' || chr(10), '' ORDER BY ds)
                AS forecast_text FROM fc GROUP BY region),
subs AS (SELECT region, sub_category, sum(profit) AS p, {_MEAN_D} * 100.0 AS d
         FROM sales WHERE region IS NOT NULL AND sub_category IS NOT NULL
         GROUP BY region, sub_category HAVING sum(profit) < 0),
rcs AS (SELECT region, string_agg('- ' || sub_category || ': Loss: ' || {_money("p", 4)}
                                  || ', Discount: ' || {_fixed("d", 1)} || '%' || chr(10), ''
                                  ORDER BY p, sub_category) AS rc FROM subs GROUP BY region),
kpi AS (SELECT region, sum(sales) AS ts, sum(profit) AS tp, {_MEAN_D} * 100.0 AS ad
        FROM sales WHERE region IS NOT NULL GROUP BY region),
summ AS (SELECT kpi.region, chr(10) || '    Business KPIs:' || chr(10) || '    - Total Sales: ' || {_money("ts", 2)}
                || chr(10) || '    - Total Profit: ' || {_money("tp", 4)} || chr(10)
                || '    - Profit Margin: ' || {_fixed(_MARGIN_SQL, 2)}
                || '%' || chr(10) || '    - Average Discount: ' || {_fixed("coalesce(ad, 0.0)", 2)} || '%'
                || chr(10) || '    ' || chr(10)
                || 'Root Cause: Underperforming sub-categories show average discounts like:' || chr(10)
                || coalesce(rcs.rc, '') AS summary
         FROM kpi LEFT JOIN rcs USING (region))
SELECT summ.region,
       '# Executive Business Report' || chr(10) || chr(10) || '## 1. System Performance Overview' || chr(10)
       || summary || chr(10) || chr(10) || '## 2. Root Cause Analysis' || chr(10) || 'No details available.'
       || chr(10) || chr(10) || '## 3. Sales Forecasting & Analysis' || chr(10)
       || coalesce(ft.forecast_text, '') || chr(10) || chr(10)
       || '## 4. Strategic Recommendations & Action Plan' || chr(10) || '' || chr(10) AS report
FROM summ LEFT JOIN ft USING (region)"""


# planner replies in which every rule of the parser matters, derived from the turns
_HARD = """(SELECT conv_id, turn, CASE (conv_id + turn) % 7
    WHEN 0 THEN ' ```json' || chr(10) || '["analysis", "forecast"]' || chr(10) || '``` '
    WHEN 1 THEN '["forecast", "' || role || '", 3, null]' WHEN 2 THEN '["analysis",' WHEN 3 THEN '{"plan": ["analysis"]}'
    WHEN 4 THEN chr(10) || '["recommendation","analysis","bogus"]' || chr(10)
    WHEN 5 THEN '```json' || chr(10) || '[]' || chr(10) || '```' ELSE text END AS text, 'assistant' AS role
  FROM conversations) AS hard"""
ORACLE["parse_plan_hard"] = ORACLE["parse_plan"].replace("FROM conversations", f"FROM {_HARD}")
ORACLE["resolve_plan_hard"] = ORACLE["resolve_plan"].replace("FROM conversations", f"FROM {_HARD}")


def _lines(text: str, indent: int) -> str:
    """SQL text of lines; an empty line carries the indentation."""
    pad = " " * indent
    return " || chr(10) || ".join("'" + (pad + x).replace("'", "''") + "'" for x in text.split("\n"))


_REGION = SALES_CTE + _monthly_ctes("region") + _model_ctes_keyed("region") + f""",
ft AS (SELECT region, string_agg('- Date: ' || strftime(ds, '%Y-%m-%d') || ', Forecasted Sales: '
                || {_money("yhat", 4)} || ' (Confidence: ' || {_money(f"yhat - {_Z80} * sd", 4)}
                || ' to ' || {_money(f"yhat + {_Z80} * sd", 4)} || ')' || chr(10), '' ORDER BY ds) AS t
       FROM fc GROUP BY region),
subs AS (SELECT region, sub_category, sum(profit) AS p, sum(sales) AS s, {_MEAN_D} * 100.0 AS d
         FROM sales WHERE region IS NOT NULL AND sub_category IS NOT NULL GROUP BY ALL HAVING sum(profit) < 0)"""

ORACLE["prompt_forecast"] = _REGION + f"""
SELECT region, chr(10) || {_lines("You are a Senior Business Analyst.", 4)} || chr(10)
  || {_lines("Analyze the following sales forecast results:", 4)} || chr(10) || {_lines("", 4)} || chr(10)
  || {_lines("Forecasted Sales for the Next 6 Months:", 4)} || chr(10) || '    ' || t || chr(10) || {_lines("", 4)} || chr(10)
  || {_lines("Provide:", 4)} || chr(10) || {_lines("1. Overall Revenue Trend (increasing, decreasing, stable).", 4)} || chr(10)
  || {_lines("2. Best anticipated month and lowest anticipated month.", 4)} || chr(10)
  || {_lines("3. Potential business risks indicated by the confidence intervals or historical data.", 4)} || chr(10)
  || {_lines("4. Practical, high-level business insights.", 4)} || chr(10) || {_lines("", 4)} || chr(10)
  || {_lines("Format in clean markdown for an executive audience.", 4)} || chr(10) || '    ' AS prompt
FROM ft"""

ORACLE["prompt_root_cause"] = SALES_CTE + f""",
subs AS (SELECT region, sub_category, sum(profit) AS p, sum(sales) AS s, {_MEAN_D} * 100.0 AS d
         FROM sales WHERE region IS NOT NULL AND sub_category IS NOT NULL GROUP BY ALL HAVING sum(profit) < 0),
prods AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY p, sub_category, product_name) AS rn FROM (
          SELECT region, sub_category, product_name, sum(profit) AS p, sum(sales) AS s, {_MEAN_D} * 100.0 AS d
          FROM sales WHERE region IS NOT NULL AND sub_category IS NOT NULL AND product_name IS NOT NULL
          GROUP BY ALL HAVING sum(profit) < 0)) WHERE rn <= 5),
sl AS (SELECT region, string_agg('- ' || sub_category || ': Profit: ' || {_money("p", 4)} || ', Sales: ' || {_money("s", 2)}
         || ', Avg Discount: ' || {_fixed("d", 1)} || '%' || chr(10), '' ORDER BY p, sub_category) AS t FROM subs GROUP BY region),
pl AS (SELECT region, string_agg('- ' || product_name || ' (' || sub_category || '): Profit: ' || {_money("p", 4)} || ', Sales: '
         || {_money("s", 2)} || ', Avg Discount: ' || {_fixed("d", 1)} || '%' || chr(10), '' ORDER BY p, sub_category, product_name) AS t
       FROM prods GROUP BY region),
c AS (SELECT region, coalesce(covar_pop(discount, profit) / nullif(stddev_pop(discount) * stddev_pop(profit), 0), 'NaN'::DOUBLE) AS c
      FROM sales WHERE region IS NOT NULL GROUP BY region)
SELECT c.region, chr(10) || {_lines("You are a Root Cause Analysis Agent.", 8)} || chr(10)
  || {_lines("Analyze these underperforming areas in our sales dataset:", 8)} || chr(10) || {_lines("", 8)} || chr(10)
  || {_lines("Loss-making Sub-categories:", 8)} || chr(10) || '        ' || coalesce(sl.t, 'None') || chr(10) || {_lines("", 8)} || chr(10)
  || {_lines("Top Loss-making Products:", 8)} || chr(10) || '        ' || coalesce(pl.t, 'None') || chr(10) || {_lines("", 8)} || chr(10)
  || '        Correlation between Discount and Profit: ' || CASE WHEN isnan(c) THEN 'nan' ELSE {_fixed("c", 4)} END || chr(10)
  || {_lines("", 8)} || chr(10) || {_lines("Explain:", 8)} || chr(10)
  || {_lines("1. Why these specific categories/products are losing money.", 8)} || chr(10)
  || {_lines("2. The role discount is playing in these losses (e.g., discount erosion).", 8)} || chr(10)
  || {_lines("3. Make it clear, concise, and formatted in markdown.", 8)} || chr(10) || '        ' AS prompt
FROM c LEFT JOIN sl USING (region) LEFT JOIN pl USING (region)"""

ORACLE["prompt_recommendation"] = _REGION + f""",
rcs AS (SELECT region, string_agg('- ' || sub_category || ': Loss: ' || {_money("p", 4)} || ', Discount: ' || {_fixed("d", 1)} || '%'
          || chr(10), '' ORDER BY p, sub_category) AS rc FROM subs GROUP BY region),
kpi AS (SELECT region, sum(sales) AS ts, sum(profit) AS tp, {_MEAN_D} * 100.0 AS ad FROM sales WHERE region IS NOT NULL GROUP BY region)
SELECT kpi.region, chr(10) || {_lines("You are a Lead Business Consultant.", 4)} || chr(10)
  || {_lines("Review the following business data, root cause explanation, and sales forecast insights:", 4)} || chr(10)
  || {_lines("", 4)} || chr(10) || '    ' || chr(10) || {_lines("Business KPIs:", 4)} || chr(10)
  || '    - Total Sales: ' || {_money("ts", 2)} || chr(10) || '    - Total Profit: ' || {_money("tp", 4)} || chr(10)
  || '    - Profit Margin: ' || {_fixed(_MARGIN_SQL, 2)} || '%' || chr(10)
  || '    - Average Discount: ' || {_fixed("coalesce(ad, 0.0)", 2)} || '%' || chr(10) || '    ' || chr(10)
  || 'Root Cause: Underperforming sub-categories show average discounts like:' || chr(10) || coalesce(rc, '') || chr(10)
  || {_lines("", 4)} || chr(10) || {_lines("Forecast Insights:", 4)} || chr(10) || '    ' || coalesce(ft.t, '') || chr(10)
  || {_lines("", 4)} || chr(10) || {_lines("Provide:", 4)} || chr(10)
  || {_lines("1. Executive Summary: Quick overview of state of the business.", 4)} || chr(10)
  || {_lines("2. Priority Action Items: Clear, bulleted action items with assigned priorities (High, Medium, Low).", 4)} || chr(10)
  || {_lines("3. Growth Opportunities: Where to invest or allocate capital based on profitable segments/regions.", 4)} || chr(10)
  || {_lines("4. Risk Mitigation Strategies: How to fix the loss-making segments or pricing structures.", 4)} || chr(10)
  || {_lines("5. Final Business Decision/Verdict.", 4)} || chr(10) || {_lines("", 4)} || chr(10)
  || {_lines("Format the response in clean, professional markdown.", 4)} || chr(10) || '    ' AS prompt
FROM kpi LEFT JOIN rcs USING (region) LEFT JOIN ft USING (region)"""

ORACLE["report_sink"] = f"""
SELECT region AS report_key, line, count(*) AS n_lines
FROM (SELECT region, unnest(string_split(report, chr(10))) AS line FROM ({ORACLE["final_report_by_region"]})) GROUP BY ALL"""


def _json_rows(part: str, name: str, where: str, group: str, order: str, more: str = "") -> str:
    return f"""SELECT '{part}' AS part, row_number() OVER (ORDER BY {order}) - 1 AS at, {name} AS name,
       round(s, 2) AS a, round(p, 2) AS b
FROM (SELECT {group}, sum(sales) AS s, sum(profit) AS p FROM sales WHERE {where} GROUP BY ALL {more})"""


ORACLE["results_json_rows"] = SALES_CTE + _monthly_ctes() + _MODEL_CTES + "\n" + " UNION ALL ".join([
    _json_rows("regional_analysis", "region", "region IS NOT NULL", "region", "region"),
    _json_rows("category_analysis", "category", "category IS NOT NULL", "category", "category"),
    _json_rows("subcategory_analysis", "category || '/' || sub_category", "category IS NOT NULL AND sub_category IS NOT NULL",
               "category, sub_category", "category, sub_category"),
    _json_rows("loss_subcategories", "sub_category", "sub_category IS NOT NULL", "sub_category", "p, sub_category",
               "HAVING sum(profit) < 0"),
    _json_rows("loss_products", "sub_category || '/' || product_name", "sub_category IS NOT NULL AND product_name IS NOT NULL",
               "sub_category, product_name", "p, sub_category, product_name",
               "HAVING sum(profit) < 0 ORDER BY p, sub_category, product_name LIMIT 10"),
    """SELECT 'predictions', row_number() OVER (ORDER BY ds) - 1, strftime(ds, '%Y-%m-%d'), round(yhat, 2), NULL FROM fc""",
    """SELECT 'history', row_number() OVER (ORDER BY ds) - 1, strftime(ds, '%Y-%m-%d'), round(y, 2), NULL
FROM (SELECT * FROM s ORDER BY ds DESC LIMIT 12)"""])
