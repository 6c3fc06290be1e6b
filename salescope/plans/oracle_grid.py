"""DuckDB SQL oracles for the CSV path, cleaning, formats, de-duplication and grid queries."""

from __future__ import annotations

from salescope.plans.oracle import _KPI_COLS, ORACLE, SALES_CTE

# Fixed values, written out apart from the implementation's: missing-value tokens of a pandas CSV
# read, and the characters that Python's str.strip() removes (as code points).
_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
       "NULL", "NaN", "None", "n/a", "nan", "null")
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                            0x202F, 0x205F, 0x3000]))

# The CSV path must reproduce the Parquet path's results exactly.
ORACLE["csv_kpi_category"] = ORACLE["kpi_category"]
ORACLE["csv_monthly_sales"] = ORACLE["monthly_sales"]

ORACLE["coerce_numeric"] = SALES_CTE + """
SELECT region, category, sub_category, segment, product_name,
       round(sales, 2) AS sales, round(discount, 6) AS discount, round(profit, 4) AS profit
FROM sales"""

ORACLE["parse_dates"] = SALES_CTE + """
SELECT strftime(order_date, '%Y-%m-%d') AS order_date, count(*) AS n_rows FROM sales GROUP BY 1"""

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in _NA)

ORACLE["na_tokens"] = f"""
SELECT conv_id, turn,
       CASE WHEN role IN ({_TOKENS}) THEN NULL ELSE role END AS role,
       CASE WHEN text IN ({_TOKENS}) THEN NULL ELSE text END AS text
FROM conversations"""

ORACLE["format_money_pct"] = SALES_CTE + """
SELECT category, sub_category,
       '$' || format('{:,.2f}', round(sum(sales), 2)) AS sales_text,
       '$' || format('{:,.2f}', round(sum(profit), 4)) AS profit_text,
       format('{:.2f}', round(CASE WHEN sum(sales) > 0 THEN sum(profit) / sum(sales) * 100.0 ELSE 0.0 END, 6))
         AS margin_text,
       format('{:.1f}', round((sum(round(discount * 100)::BIGINT) / 100.0 / count(discount)) * 100.0, 6)) AS discount_text
FROM sales WHERE category IS NOT NULL AND sub_category IS NOT NULL
GROUP BY category, sub_category"""

ORACLE["catalog_dedup"] = """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1"""

ORACLE["preview"] = """
SELECT coalesce(CAST(l_orderkey AS VARCHAR), '') AS l_orderkey,
       coalesce(CAST(l_partkey AS VARCHAR), '') AS l_partkey,
       coalesce(CAST(l_suppkey AS VARCHAR), '') AS l_suppkey,
       coalesce(CAST(l_linenumber AS VARCHAR), '') AS l_linenumber,
       coalesce(CAST(l_quantity AS VARCHAR), '') AS l_quantity,
       coalesce(CAST(l_extendedprice AS VARCHAR), '') AS l_extendedprice,
       coalesce(CAST(l_discount AS VARCHAR), '') AS l_discount,
       coalesce(CAST(l_tax AS VARCHAR), '') AS l_tax,
       coalesce(l_returnflag, '') AS l_returnflag,
       coalesce(l_linestatus, '') AS l_linestatus,
       coalesce(CAST(l_shipdate AS VARCHAR), '') AS l_shipdate
FROM (SELECT * FROM lineitem LIMIT 100)"""

ORACLE["nonblank_texts"] = f"""
SELECT doc_id, t AS text FROM (
  SELECT doc_id, trim(text, '{_SPACES}') AS t FROM documents)
WHERE t <> ''"""

_GRID_COLS = """strftime(order_date, '%Y-%m-%d') AS order_date, region, category, sub_category, segment,
       product_name, round(sales, 2) AS sales, round(discount, 6) AS discount, round(profit, 4) AS profit"""

ORACLE["grid_filter"] = SALES_CTE + f"""
SELECT {_GRID_COLS} FROM sales WHERE region = 'EUROPE' AND category = 'PROMO'"""

ORACLE["grid_search"] = SALES_CTE + f"""
SELECT {_GRID_COLS} FROM sales
WHERE coalesce(contains(lower(region), 'plate'), false) OR coalesce(contains(lower(category), 'plate'), false)
   OR coalesce(contains(lower(sub_category), 'plate'), false) OR coalesce(contains(lower(segment), 'plate'), false)
   OR coalesce(contains(lower(product_name), 'plate'), false)"""

ORACLE["grid_sort"] = SALES_CTE + f"""
SELECT {_GRID_COLS} FROM sales
ORDER BY sales DESC, strftime(order_date, '%Y-%m-%d'), region, category, sub_category, segment, product_name,
         discount, profit
LIMIT 100"""

ORACLE["csv_mixed_layouts"] = ORACLE["kpi_category"]

ORACLE["stream_landing_kpi"] = SALES_CTE + """
SELECT region, round(sum(sales), 2) AS sales, round(sum(profit), 4) AS profit FROM sales
WHERE region IS NOT NULL GROUP BY region"""

ORACLE["land_dataset"] = SALES_CTE + f"""
SELECT dataset || '.csv' AS dataset, region, {_KPI_COLS} FROM (
  SELECT sales.*, d.dataset FROM sales JOIN (SELECT DISTINCT region AS dataset FROM sales) d
  ON region = d.dataset OR (d.dataset = (SELECT min(region) FROM sales) AND region = (SELECT max(region) FROM sales)))
WHERE region IS NOT NULL GROUP BY dataset, region"""

ORACLE["feedback"] = """
SELECT via, role AS category, (turn % 5 + 1)::INTEGER AS rating, count(*) AS n_rows
FROM conversations CROSS JOIN (VALUES ('files'), ('stream')) AS v(via) GROUP BY ALL"""

ORACLE["dataset_catalog"] = SALES_CTE + """
SELECT region || '.csv' AS filename, sum(strlen(concat_ws(',', category, product_name)) + 1)::BIGINT AS bytes,
       region = (SELECT max(region) FROM sales) AS active, 'config' AS source,
       'first:' || (SELECT min(region) FROM sales) || '.csv' AS without, true AS recent
FROM sales GROUP BY region"""

ORACLE["feedback_quarantine"] = """
SELECT kind, CASE WHEN kind = 'entry' THEN role ELSE '-' END AS category, CASE WHEN kind = 'entry' THEN turn % 5 + 1 ELSE 0 END::INTEGER AS rating,
       count(*) AS n_rows, sum(CASE WHEN kind = 'entry' THEN length(text) ELSE 0 END)::BIGINT AS chars
FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN 'malformed' ELSE 'entry' END AS kind FROM conversations) GROUP BY ALL"""

ORACLE["na_tokens_hard"] = f"""
SELECT o_orderkey, CASE WHEN cell IN ({_TOKENS}) THEN NULL ELSE cell END AS cell FROM (
  SELECT o_orderkey, ['N/A', 'NA', '-', 'null', 'Null', ' NA', '', 'nan', 'NONE', 'None', '#N/A', '0', '1.#IND', 'n/a '][
    (o_orderkey % 14 + 1)::INTEGER] AS cell FROM orders)"""

ORACLE["coerce_numeric_hard"] = """
SELECT l_orderkey, l_linenumber, round(CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN p WHEN 3 THEN p WHEN 4 THEN '-inf'::DOUBLE WHEN 7 THEN p * 10 ELSE 0.0 END, 1) AS v
FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS p FROM lineitem)"""

ORACLE["parse_dates_hard"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"""

ORACLE["nonblank_texts_hard"] = f"""
SELECT doc_id, trim(text, '{_SPACES}') AS text FROM documents
WHERE doc_id % 4 <> 1 AND trim(text, '{_SPACES}') <> ''"""

ORACLE["grid_sort_all"] = SALES_CTE + f"""
SELECT {_GRID_COLS}, row_number() OVER (ORDER BY sales, strftime(order_date, '%Y-%m-%d'), region, category, sub_category, segment,
       product_name, discount, profit) - 1 AS place
FROM sales"""

ORACLE["preview_head"] = """
SELECT * FROM (SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), '') FROM (SELECT * FROM orders LIMIT 5))"""
