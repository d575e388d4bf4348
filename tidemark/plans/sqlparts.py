"""SQL text for the DuckDB oracle side of the query catalog.

Each oracle recomputes the Spark result from the raw tables in plain SQL.
Floats are rounded to a fixed number of decimals chosen per column so that
both engines agree despite different summation orders.
"""

from __future__ import annotations

# Decimals kept per month-panel column (about 9-10 significant digits).
DIGITS = {
    "n_orders": 8, "n_customers": 8, "avg_order_value": 4, "avg_qty": 8,
    "avg_tax": 10, "ret_share": 10, "y": 10,
}

PANEL_CTE = """
li AS (
  SELECT l_orderkey, count(*) AS lines, sum(CAST(l_quantity AS BIGINT)) AS qty,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS gross_c,
         sum(CAST(round(l_extendedprice * l_discount * 10000) AS BIGINT)) AS disc_e4,
         sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_c,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ret
  FROM lineitem GROUP BY l_orderkey),
panel AS (
  SELECT series_id, period, period // 100 AS year, n_orders, n_customers,
         value_c / n_orders / 100 AS avg_order_value,
         qty / lines AS avg_qty, tax_c / lines / 100 AS avg_tax,
         ret / lines AS ret_share, disc_e4 / gross_c / 100 AS y
  FROM (
    SELECT c.c_mktsegment AS series_id,
           CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS BIGINT) AS period,
           CAST(count(*) AS BIGINT) AS n_orders,
           CAST(count(DISTINCT o.o_custkey) AS BIGINT) AS n_customers,
           CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value_c,
           CAST(sum(li.lines) AS BIGINT) AS lines, CAST(sum(li.qty) AS BIGINT) AS qty,
           CAST(sum(li.tax_c) AS BIGINT) AS tax_c, CAST(sum(li.ret) AS BIGINT) AS ret,
           CAST(sum(li.disc_e4) AS BIGINT) AS disc_e4, CAST(sum(li.gross_c) AS BIGINT) AS gross_c
    FROM orders o JOIN li ON o.o_orderkey = li.l_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    GROUP BY 1, 2) t)
"""


def R(expr: str, digits: int) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def with_panel(body: str, extra_ctes: str = "") -> str:
    ctes = PANEL_CTE.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body}"
