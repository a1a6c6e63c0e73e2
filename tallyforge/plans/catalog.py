"""All queries of the core over the driver tables, and for each its equal in SQL where SQL can say it."""

from __future__ import annotations

import re
import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dates import FORMATS, parse_date
from tallyforge.functions.values import finite, number, strip
from tallyforge.operators import cleaning as C
from tallyforge.operators import dataset as D
from tallyforge.operators import metrics as M
from tallyforge.operators import quality as Q
from tallyforge.operators.lazy import LargeDataAsset, as_of_join, check_query, to_spark_dialect
from tallyforge.plans import training_queries, training_sql
from tallyforge.reporting.charts import top_products_chart
from tallyforge.session import shared_folder, table
from tallyforge.sources.loaders import load
from tallyforge.sources.writers import write_table
from tallyforge.streaming.windows import sessions, windowed_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(training_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(training_sql.ORACLE_SQL)

SEM = {
    "order": "order_id", "customer": "customer_id", "product": "product_id", "category": "category", "date": "order_date", "discount": "discount_pct", "cost": "cost", "profit": "profit", "revenue": "revenue",
    "quantity": "quantity", "price": "unit_price",
}
SALES_SQL = """
WITH sales AS (
  SELECT o.o_orderkey AS order_id, o.o_orderdate AS order_date, o.o_custkey AS customer_id, l.l_partkey AS product_id, c.c_mktsegment AS category, l.l_quantity AS quantity,
         p.p_retailprice AS unit_price, l.l_extendedprice * (1 - l.l_discount) AS revenue, 2 * l.l_quantity * p.p_retailprice AS cost, l.l_discount * 100 AS discount_pct, l.l_linenumber AS line
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey),
fact AS (SELECT *, revenue - cost AS profit FROM sales)
"""


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their order, customer and part; the derived profit is added by the operator, not here."""
    line, order, cust, part = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(cust, order.o_custkey == cust.c_custkey).join(part, line.l_partkey == part.p_partkey)
    c = F.col
    return joined.select(
        c("o_orderkey").alias("order_id"), c("o_orderdate").alias("order_date"), c("o_custkey").alias("customer_id"), c("l_partkey").alias("product_id"), c("c_mktsegment").alias("category"), c("l_quantity").alias("quantity"),
        c("p_retailprice").alias("unit_price"), (c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"), (2 * c("l_quantity") * c("p_retailprice")).alias("cost"), (c("l_discount") * 100).alias("discount_pct"), c("l_linenumber").alias("line"),
    )


def fact(spark: SparkSession, d: str) -> DataFrame:
    without = {k: v for k, v in SEM.items() if k != "profit"}
    df, _, _ = M.ensure_profit(sales(spark, d), without)
    return df.withColumnRenamed(M.PROFIT, "profit")


def query(name: str, sql: str | None = None, sales_sql: bool = False):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (SALES_SQL if sales_sql else "") + sql
        return f

    return keep


def dsum(x: str) -> str:
    """SQL of a sum: four places as exact decimals, what is left of each value below them as doubles."""
    return f"(COALESCE(CAST(SUM(CAST({x} AS DECIMAL(28,4))) AS DOUBLE), 0) + COALESCE(SUM(({x}) - CAST(CAST({x} AS DECIMAL(28,4)) AS DOUBLE)), 0))"


# --- KPIs -------------------------------------------------------------------------------------------------------------


@query("kpi_totals", f"SELECT {dsum('revenue')} AS total_revenue, {dsum('cost')} AS total_cost, {dsum('profit')} AS total_profit, {dsum('quantity')} AS total_quantity FROM fact", True)
def _(s, d):
    return M.kpis(fact(s, d), SEM).select("total_revenue", "total_cost", "total_profit", "total_quantity")


@query("kpi_margin", f"SELECT ROUND(100 * {dsum('profit')} / {dsum('revenue')}, 2) AS profit_margin_pct FROM fact", True)
def _(s, d):
    return M.kpis(fact(s, d), SEM).select("profit_margin_pct")


@query("kpi_aov_asp", f"SELECT ROUND({dsum('revenue')} / COUNT(DISTINCT order_id), 2) AS average_order_value, ROUND({dsum('revenue')} / {dsum('quantity')}, 2) AS average_selling_price FROM fact", True)
def _(s, d):
    return M.kpis(fact(s, d), SEM).select("average_order_value", "average_selling_price")


@query("kpi_distincts", "SELECT COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT product_id) AS products FROM fact", True)
def _(s, d):
    return M.kpis(fact(s, d), SEM).select("orders", "customers", "products")


@query("kpi_discount", f"SELECT ROUND(AVG(discount_pct), 2) AS average_discount_pct, CASE WHEN MAX(discount_pct) > 1 AND MAX(discount_pct) <= 150 THEN ROUND({dsum('revenue * discount_pct / 100')}, 2) END AS total_discount_value FROM fact", True)
def _(s, d):
    return M.kpis(fact(s, d), SEM).select("average_discount_pct", "total_discount_value")


@query("kpi_order_fallback", f"SELECT COUNT(*) AS orders, ROUND({dsum('revenue')} / COUNT(*), 2) AS average_order_value FROM fact", True)
def _(s, d):
    return M.kpis(fact(s, d), {k: v for k, v in SEM.items() if k != "order"}).select("orders", "average_order_value")


@query("kpi_derived_profit", f"SELECT {dsum('profit')} AS total_profit, ROUND(100 * {dsum('profit')} / {dsum('revenue')}, 2) AS profit_margin_pct FROM fact", True)
def _(s, d):
    """Without a profit column: revenue - cost."""
    return M.kpis(sales(s, d), {k: v for k, v in SEM.items() if k != "profit"}).select("total_profit", "profit_margin_pct")


@query("derived_profit", "SELECT order_id, CAST(line AS BIGINT) AS line, ROUND(profit, 4) AS derived_profit FROM fact", True)
def _(s, d):
    return fact(s, d).select("order_id", F.col("line").cast("bigint").alias("line"), F.round("profit", 4).alias("derived_profit"))


# --- categories, products, customers -----------------------------------------------------------------------------------

BY_CATEGORY = f"g AS (SELECT category, {dsum('revenue')} AS revenue, {dsum('profit')} AS profit FROM fact WHERE category IS NOT NULL GROUP BY category)"
BY_PRODUCT = f"g AS (SELECT product_id AS product, {dsum('revenue')} AS revenue, {dsum('profit')} AS profit, {dsum('quantity')} AS quantity, AVG(discount_pct) AS avg_discount FROM fact WHERE product_id IS NOT NULL GROUP BY product_id)"
BY_CUSTOMER = f"g AS (SELECT customer_id AS customer, COUNT(DISTINCT order_id) AS orders, {dsum('revenue')} AS revenue, {dsum('profit')} AS profit FROM fact WHERE customer_id IS NOT NULL GROUP BY customer_id)"


@query("category_revenue_share", f", {BY_CATEGORY} SELECT category, revenue, ROUND(100 * revenue / SUM(revenue) OVER (), 2) AS share_pct FROM g", True)
def _(s, d):
    return M.category_revenue(fact(s, d), SEM)


@query("category_profit", f", {BY_CATEGORY} SELECT category, profit FROM g", True)
def _(s, d):
    return M.group_totals(fact(s, d), SEM, "category").select(F.col("key").alias("category"), "profit")


@query("category_margin", f", {BY_CATEGORY} SELECT category, revenue, profit, ROUND(100 * profit / revenue, 2) AS margin_pct FROM g", True)
def _(s, d):
    return M.category_margin(fact(s, d), SEM)


@query("category_worst_margin", f", {BY_CATEGORY} SELECT category, ROUND(100 * profit / revenue, 2) AS margin_pct FROM g ORDER BY 2, 1 LIMIT 1", True)
def _(s, d):
    return M.worst_margin(fact(s, d), SEM).select("category", "margin_pct")


@query("pareto_category", f", {BY_CATEGORY} SELECT category AS key, revenue, ROUND(100 * SUM(revenue) OVER (ORDER BY revenue DESC, category ROWS UNBOUNDED PRECEDING) / SUM(revenue) OVER (), 4) AS cumulative_pct FROM g", True)
def _(s, d):
    return M.pareto(fact(s, d), SEM)


def _product_top(name: str, by: str, ascending: bool = False) -> None:
    @query(name, f", {BY_PRODUCT} SELECT product, {by if by != 'avg_discount' else 'ROUND(avg_discount, 6) AS avg_discount'} FROM g ORDER BY g.{by} {'ASC' if ascending else 'DESC'} NULLS LAST, product LIMIT 10", True)
    def _(s, d):
        shown = F.round(by, 6).alias(by) if by == "avg_discount" else F.col(by)
        return M.top(M.group_totals(fact(s, d), SEM, "product"), by, ascending=ascending).select(F.col("key").alias("product"), shown)


_product_top("product_top_revenue", "revenue")
_product_top("product_top_quantity", "quantity")
_product_top("product_top_profit", "profit")
_product_top("product_bottom_profit", "profit", True)


@query("top_products_chart", f", {BY_PRODUCT} SELECT product, revenue FROM g ORDER BY revenue DESC, product LIMIT 10", True)
def _(s, d):
    return top_products_chart(fact(s, d), SEM)


@query("product_top_discount", f", {BY_PRODUCT} SELECT product, ROUND(avg_discount, 6) AS avg_discount FROM g ORDER BY 2 DESC, 1 LIMIT 10", True)
def _(s, d):
    g = M.group_totals(fact(s, d), SEM, "product").withColumn("avg_discount", F.round("avg_discount", 6))
    return M.top(g, "avg_discount").select(F.col("key").alias("product"), "avg_discount")


@query("product_loss_making", f", {BY_PRODUCT} SELECT product, profit FROM g WHERE profit < 0", True)
def _(s, d):
    return M.loss_making(fact(s, d), SEM).select(F.col("key").alias("product"), "profit")


@query("unique_counts", "SELECT COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT category) AS unique_categories, COUNT(DISTINCT customer_id) AS unique_customers FROM fact", True)
def _(s, d):
    return M.unique_counts(fact(s, d), SEM)


@query("customer_orders_summary", f", {BY_CUSTOMER} SELECT COUNT(*) AS unique_customers, ROUND(AVG(orders), 6) AS average_orders, COUNT(*) FILTER (WHERE orders > 1) AS repeat_customers, COUNT(*) FILTER (WHERE orders = 1) AS one_time_customers FROM g", True)
def _(s, d):
    return M.customer_summary(fact(s, d), SEM).select("unique_customers", F.round("average_orders", 6).alias("average_orders"), "repeat_customers", "one_time_customers")


@query("customer_orders_ecommerce", "WITH g AS (SELECT customer_id, COUNT(DISTINCT order_id) AS orders FROM ecommerce WHERE customer_id IS NOT NULL GROUP BY 1) SELECT COUNT(*) AS unique_customers, ROUND(AVG(orders), 6) AS average_orders, COUNT(*) FILTER (WHERE orders > 1) AS repeat_customers, COUNT(*) FILTER (WHERE orders = 1) AS one_time_customers FROM g")
def _(s, d):
    out = M.customer_summary(table(s, d, "ecommerce"), {"customer": "customer_id", "order": "order_id"})
    return out.withColumn("average_orders", F.round("average_orders", 6))


@query("customer_top", f", {BY_CUSTOMER} SELECT customer, revenue FROM g ORDER BY revenue DESC, customer LIMIT 10", True)
def _(s, d):
    return M.top(M.per_customer(fact(s, d), SEM), "revenue").select(F.col("key").alias("customer"), "revenue")


@query("customer_bottom", f", {BY_CUSTOMER} SELECT customer, revenue FROM g ORDER BY revenue, customer LIMIT 10", True)
def _(s, d):
    return M.top(M.per_customer(fact(s, d), SEM), "revenue", ascending=True).select(F.col("key").alias("customer"), "revenue")


@query("customer_concentration", f", {BY_CUSTOMER} SELECT ROUND(100 * (SELECT SUM(revenue) FROM (SELECT revenue FROM g ORDER BY revenue DESC, customer LIMIT 5)) / (SELECT SUM(revenue) FROM g), 2) AS top5_revenue_concentration_pct", True)
def _(s, d):
    return M.customer_summary(fact(s, d), SEM).select("top5_revenue_concentration_pct")


@query("customer_avg_profit", f", {BY_CUSTOMER} SELECT ROUND(AVG(revenue), 4) AS average_revenue, ROUND(AVG(profit), 4) AS average_profit FROM g", True)
def _(s, d):
    return M.customer_summary(fact(s, d), SEM).select(F.round("average_revenue", 4).alias("average_revenue"), F.round("average_profit", 4).alias("average_profit"))


# --- time ---------------------------------------------------------------------------------------------------------------

MONTHS_SQL = f"""
, m AS (SELECT last_day(order_date) AS period, {dsum('revenue')} AS value FROM fact GROUP BY 1),
spine AS (SELECT CAST(last_day(CAST(x AS DATE)) AS DATE) AS period FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT MIN(order_date) FROM fact)), date_trunc('month', (SELECT MAX(order_date) FROM fact)), INTERVAL 1 MONTH)) AS x)),
t AS (SELECT spine.period, COALESCE(value, 0) AS value FROM spine LEFT JOIN m ON spine.period = m.period)
"""


def _shown_trend(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 2).alias("value"), F.round("rolling_average", 2).alias("rolling_average"))


@query("trend_monthly", MONTHS_SQL + "SELECT strftime(period, '%Y-%m-%d') AS period, ROUND(value, 2) AS value, ROUND(AVG(value) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling_average FROM t", True)
def _(s, d):
    return _shown_trend(M.trend(fact(s, d), SEM, "revenue", "monthly"))


@query("trend_daily", f"""
WITH g AS (SELECT CAST(ts AS DATE) AS period, {dsum('value')} AS value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT MIN(period) FROM g), (SELECT MAX(period) FROM g), INTERVAL 1 DAY)) AS DATE) AS period),
t AS (SELECT spine.period, COALESCE(value, 0) AS value FROM spine LEFT JOIN g ON spine.period = g.period)
SELECT strftime(period, '%Y-%m-%d') AS period, ROUND(value, 2) AS value, ROUND(AVG(value) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling_average FROM t""")
def _(s, d):
    return _shown_trend(M.trend(table(s, d, "events"), {"date": "ts"}, "value", "daily"))


@query("trend_growth_mom_yoy", MONTHS_SQL + """
, w AS (SELECT period, value, FIRST_VALUE(value) OVER (ORDER BY period) AS f, LAG(value, 1) OVER (ORDER BY period) AS b, LAG(value, 12) OVER (ORDER BY period) AS y FROM t)
SELECT ROUND(100 * (value - f) / ABS(f), 2) AS growth_pct, ROUND(100 * (value - b) / ABS(b), 2) AS mom_pct, ROUND(100 * (value - y) / ABS(y), 2) AS yoy_pct FROM w ORDER BY period DESC LIMIT 1""", True)
def _(s, d):
    return M.trend_changes(M.trend(fact(s, d), SEM, "revenue", "monthly"))


def _growth_sql(key: str) -> str:
    return f"""
, mid AS (SELECT MIN(order_date) + (MAX(order_date) - MIN(order_date)) / 2 AS mid FROM fact WHERE {key} IS NOT NULL),
h AS (SELECT {key} AS key, {dsum('CASE WHEN order_date <= mid THEN revenue END')} AS first_half, {dsum('CASE WHEN order_date > mid THEN revenue END')} AS second_half FROM fact, mid WHERE {key} IS NOT NULL GROUP BY 1),
c AS (SELECT *, CASE WHEN first_half <> 0 THEN ROUND(100 * (second_half - first_half) / ABS(first_half), 2) + 0 WHEN second_half > 0 THEN 100 ELSE 0 END AS change_pct FROM h WHERE first_half <> 0 OR second_half <> 0),
r AS (SELECT *, CASE WHEN change_pct > 5 THEN 'growing' WHEN change_pct < -5 THEN 'declining' ELSE 'flat' END AS status FROM c)
"""


@query("growth_category", _growth_sql("category") + "SELECT key, first_half, second_half, change_pct, status FROM r", True)
def _(s, d):
    return M.growth(fact(s, d), SEM, "category", "revenue")


@query("growth_product", _growth_sql("product_id") + "SELECT key, first_half, second_half, change_pct, status FROM r", True)
def _(s, d):
    return M.growth(fact(s, d), SEM, "product", "revenue")


@query("growth_status_topk", _growth_sql("product_id") + "(SELECT key, change_pct, status FROM r WHERE status = 'growing' ORDER BY change_pct DESC, key LIMIT 10) UNION ALL (SELECT key, change_pct, status FROM r WHERE status = 'declining' ORDER BY change_pct, key LIMIT 10)", True)
def _(s, d):
    g = M.growth(fact(s, d), SEM, "product", "revenue").select("key", "change_pct", "status")
    up = g.where(F.col("status") == "growing").orderBy(F.desc("change_pct"), "key").limit(10)
    return up.unionByName(g.where(F.col("status") == "declining").orderBy("change_pct", "key").limit(10))


# --- quality ------------------------------------------------------------------------------------------------------------

ECOM = ["order_id", "order_date", "customer_id", "category", "quantity", "revenue", "profit"]
ECOM_NUM = ["quantity", "revenue", "profit"]
FIN = lambda c: f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
CELLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {FIN(c)} AS v FROM ecommerce" for c in ECOM_NUM)


def orders_as_delivered(s: SparkSession, d: str) -> DataFrame:
    return Q.flatten(table(s, d, "ecommerce")).select(*ECOM)


def _null(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in ("revenue", "profit") else f"{c} IS NULL"


@query("missing_report", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {_null(c)}) AS missing FROM ecommerce" for c in ECOM))
def _(s, d):
    return Q.missing_counts(orders_as_delivered(s, d))


@query("duplicate_rows", f"WITH n AS (SELECT {', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' if c in ('revenue', 'profit') else c for c in ECOM)} FROM ecommerce), g AS (SELECT COUNT(*) AS k FROM n GROUP BY {', '.join(ECOM)}) SELECT CAST(SUM(k) AS BIGINT) AS rows, COUNT(*) AS distinct_rows, CAST(SUM(k) - COUNT(*) AS BIGINT) AS duplicate_rows FROM g")
def _(s, d):
    return Q.duplicate_rows(orders_as_delivered(s, d))


@query("duplicate_ids", "SELECT CAST(COUNT(*) - COUNT(DISTINCT customer_id) - MAX(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_ids FROM ecommerce")
def _(s, d):
    return Q.duplicate_ids(table(s, d, "ecommerce"), "customer_id")


@query("negative_values", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {FIN(c)} < 0) AS negatives FROM ecommerce" for c in ECOM_NUM))
def _(s, d):
    return Q.negative_values(table(s, d, "ecommerce"), ECOM_NUM)


def _sql_format(f: str) -> str:
    return f.replace("yyyyMMdd", "%Y%m%d").replace("yyyy", "%Y").replace("MMM", "%b").replace("M", "%m").replace("d", "%d").replace("y", "%Y").replace("H", "%H").replace(":m", ":%M").replace(":s", ":%S").replace("%%", "%")


@query("iqr_outliers", f"WITH c AS ({CELLS}), b AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM c GROUP BY 1) SELECT c.column_name, COUNT(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM c JOIN b ON c.column_name = b.column_name WHERE q3 > q1 GROUP BY 1")
def _(s, d):
    return Q.iqr_outliers(table(s, d, "ecommerce"), ECOM_NUM)


Z_SQL = f"WITH f AS (SELECT row_id, {FIN('quantity')} AS quantity, {FIN('revenue')} AS revenue, {FIN('profit')} AS profit FROM ecommerce), m AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ECOM_NUM) + " FROM f), z AS (SELECT row_id, " + ", ".join(f"COALESCE(ABS({c} - m_{c}) / s_{c} > 3, false) AS z_{c}" for c in ECOM_NUM) + " FROM f, m) "


@query("zscore_anomalies", Z_SQL + "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE z_{c}) AS {c}_anomalies" for c in ECOM_NUM) + ", COUNT(*) FILTER (WHERE z_quantity OR z_revenue OR z_profit) AS anomalous_rows FROM z")
def _(s, d):
    z = Q.zscore_flags(table(s, d, "ecommerce"), ECOM_NUM)
    hit = F.col("z_quantity") | F.col("z_revenue") | F.col("z_profit")
    return z.agg(*[F.count_if(f"z_{c}").alias(f"{c}_anomalies") for c in ECOM_NUM], F.count_if(hit).alias("anomalous_rows"))


@query("anomaly_rows_topk", Z_SQL + "SELECT row_id FROM z WHERE z_quantity OR z_revenue OR z_profit ORDER BY row_id LIMIT 50")
def _(s, d):
    z = Q.zscore_flags(table(s, d, "ecommerce"), ECOM_NUM)
    return z.where(F.col("z_quantity") | F.col("z_revenue") | F.col("z_profit")).select("row_id").orderBy("row_id").limit(50)


@query("describe_numeric", f"WITH c AS ({CELLS}) SELECT column_name, ROUND(AVG(v), 4) AS mean, quantile_cont(v, 0.5) AS median, ROUND(stddev_samp(v), 4) AS std, MIN(v) AS min, MAX(v) AS max, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM c GROUP BY 1")
def _(s, d):
    return Q.describe(table(s, d, "ecommerce"), ECOM_NUM).withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS filled, COUNT(DISTINCT {c}) AS distinct_values, ROUND(AVG(length(CAST({c} AS VARCHAR))), 6) AS mean_length, COUNT(*) AS rows FROM messy" for c in ("feed", "order_date", "product_id", "category", "revenue", "is_active")))
def _(s, d):
    return Q.cell_counts(table(s, d, "messy").select("feed", "order_date", "product_id", "category", "revenue", "is_active")).withColumn("mean_length", F.round("mean_length", 6))


@query("dtype_profile")
def _(s, d):
    """Type label and meaning of every column of messy, as (column_name, label, concept)."""
    from tallyforge.semantics import detect_semantics

    df = table(s, d, "messy").withColumnRenamed("row_id", Q.ROW_ID)
    labels = Q.detect_types(df)
    meaning = {c: k for k, c in detect_semantics(labels).items()}
    return s.createDataFrame([(c, t, meaning.get(c)) for c, t in labels.items()], "column_name string, label string, concept string")


@query("quality_score", f"""
WITH n AS (SELECT order_id, order_date, customer_id, category, quantity, CASE WHEN isnan(revenue) THEN NULL ELSE revenue END AS revenue, CASE WHEN isnan(profit) THEN NULL ELSE profit END AS profit FROM ecommerce),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, {FIN(c)} AS v FROM n" for c in ECOM_NUM)}),
b AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM c GROUP BY 1),
o AS (SELECT COUNT(*) AS k FROM c JOIN b ON c.column_name = b.column_name WHERE q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))),
neg AS (SELECT COUNT(*) AS k FROM (SELECT column_name FROM c WHERE column_name IN ('revenue', 'quantity') AND v < 0 GROUP BY 1)),
g AS (SELECT COUNT(*) AS k FROM n GROUP BY ALL_COLUMNS),
u AS (SELECT SUM(k) AS n, COUNT(*) AS u FROM g),
miss AS (SELECT {" + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in ECOM)} AS k FROM n),
ids AS (SELECT COUNT(*) - COUNT(DISTINCT order_id) - MAX(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS k FROM n)
SELECT ROUND(100 - LEAST(0.6e0 * ROUND(100e0 * miss.k / (u.n * 7), 2), 30) - LEAST(0.8e0 * ROUND(100e0 * (u.n - u.u) / u.n, 2), 20) - LEAST(0.2e0 * (100e0 * o.k / u.n), 15) - LEAST(5e0 * neg.k, 15) - LEAST(0.3e0 * (100e0 * ids.k / u.n), 10), 1) AS quality_score
FROM o, neg, u, miss, ids""".replace("ALL_COLUMNS", ", ".join(ECOM)))
def _(s, d):
    sem = {"order": "order_id", "date": "order_date", "revenue": "revenue", "quantity": "quantity", "profit": "profit"}
    labels = {"order_id": "identifier", "order_date": "date", "customer_id": "categorical", "category": "categorical", "quantity": "float", "revenue": "float", "profit": "float"}
    return s.createDataFrame([(float(Q.quality(orders_as_delivered(s, d), sem, labels)["quality_score"]),)], "quality_score double")


CORR = ["quantity", "revenue", "profit"]


@query("correlation_matrix", "WITH f AS (SELECT " + ", ".join(f"{FIN(c)} AS {c}" for c in CORR) + " FROM ecommerce) " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, ROUND(corr({a}, {b}), 6) AS correlation FROM f" for a in CORR for b in CORR))
def _(s, d):
    return Q.correlation_matrix(table(s, d, "ecommerce"), CORR).withColumn("correlation", F.round("correlation", 6))


@query("histogram", f"WITH v AS (SELECT {FIN('value')} AS v FROM events), f AS (SELECT v FROM v WHERE v IS NOT NULL), e AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM f), p AS (SELECT CAST(LEAST(FLOOR((v - lo) / ((hi - lo) / 30)) + 1, 30) AS INTEGER) AS bin, lo, hi FROM f, e) SELECT bin, ROUND(lo + (bin - 1) * ((hi - lo) / 30), 6) AS low, ROUND(lo + bin * ((hi - lo) / 30), 6) AS high, COUNT(*) AS frequency FROM p GROUP BY bin, lo, hi")
def _(s, d):
    return Q.histogram(table(s, d, "events"), "value").withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("box_summary", f"WITH v AS (SELECT {FIN('value')} AS v FROM events), q AS (SELECT MIN(v) AS low, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, MAX(v) AS high FROM v) SELECT low, q1, median, q3, high, MIN(v) AS whisker_low, MAX(v) AS whisker_high FROM v, q WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def _(s, d):
    return Q.box_summary(table(s, d, "events"), "value")


# --- cleaning -----------------------------------------------------------------------------------------------------------

SQL_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@query("clean_strip", f"SELECT row_id, {SQL_STRIP('category')} AS category FROM messy")
def _(s, d):
    return C.strip_text(table(s, d, "messy").select("row_id", "category"))


SQL_BARE = "regexp_replace(revenue, '[\\p{Sc},%]', '', 'g')"


@query("clean_numeric", f"WITH t AS (SELECT row_id, {SQL_STRIP(SQL_BARE)} AS t FROM messy) SELECT row_id, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END AS revenue FROM t")
def _(s, d):
    return table(s, d, "messy").select("row_id", number(F.col("revenue")).alias("revenue"))


@query("clean_inf", f"SELECT row_id, {FIN('revenue')} AS revenue, {FIN('profit')} AS profit FROM ecommerce")
def _(s, d):
    return C.drop_infinite(table(s, d, "ecommerce").select("row_id", "revenue", "profit"))


@query("clean_dedupe", "SELECT order_id, order_date, category, is_active, MIN(row_id) AS row_id FROM messy GROUP BY order_id, order_date, category, is_active")
def _(s, d):
    return C.dedupe(table(s, d, "messy").select(F.col("row_id").alias(Q.ROW_ID), "order_id", "order_date", "category", "is_active")).withColumnRenamed(Q.ROW_ID, "row_id")


_DATE_TEXT = f"regexp_replace(regexp_replace({SQL_STRIP('signup_date')}, '(:\\d{{2}})(\\.\\d+)?\\s*(Z|UTC|[+-]\\d{{2}}:?\\d{{2}})?$', '\\1'), '(\\d)T(\\d)', '\\1 \\2')"
_DATE_TRIES = ", ".join(f"CASE WHEN regexp_full_match(t, '{p}') THEN try_strptime(t, '{_sql_format(f)}') END" for p, f in FORMATS)


@query("clean_dates", f"WITH s AS (SELECT row_id, {_DATE_TEXT} AS t FROM customer_profile) SELECT row_id, COALESCE({_DATE_TRIES}) AS signup_date FROM s")
def _(s, d):
    return table(s, d, "customer_profile").select("row_id", parse_date(F.col("signup_date")).alias("signup_date"))


@query("invalid_dates", f"WITH s AS (SELECT signup_date, {_DATE_TEXT} AS t FROM customer_profile) SELECT COUNT(*) FILTER (WHERE signup_date IS NOT NULL AND COALESCE({_DATE_TRIES}) IS NULL) AS invalid_dates FROM s")
def _(s, d):
    return Q.invalid_dates(table(s, d, "customer_profile"), "signup_date")


LABELLED = ["feed", "order_date", "product_id", "category", "revenue", "is_active"]


def _label_sql(c: str) -> str:
    text = _DATE_TEXT.replace("signup_date", c)
    ratio = f"SELECT '{c}' AS column_name, COUNT({c}) AS filled, COUNT(*) AS n, COUNT(DISTINCT {c}) AS k, AVG(length({c})) AS l, COUNT(COALESCE({_DATE_TRIES})) / COUNT({c}) AS dates, {'true' if 'date' in c else 'false'} AS hint FROM (SELECT {c}, {text} AS t FROM messy)"
    return f"SELECT column_name, CASE WHEN filled = 0 THEN 'unknown' WHEN dates >= 0.85 OR hint AND dates >= 0.5 THEN 'date' WHEN k / n > 0.9 AND k > 20 THEN 'identifier' WHEN k / n < 0.5 OR l < 30 THEN 'categorical' ELSE 'text' END AS label FROM ({ratio})"


@query("dtype_labels", " UNION ALL ".join(_label_sql(c) for c in LABELLED))
def _(s, d):
    return s.createDataFrame(list(Q.detect_types(table(s, d, "messy").select(*LABELLED)).items()), "column_name string, label string")


# --- lazy tables and SQL --------------------------------------------------------------------------------------------------


def _lazy(s: SparkSession, d: str, name: str) -> LargeDataAsset:
    return LargeDataAsset(table(s, d, name))


@query("lazy_aggregate", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {dsum('l_quantity')} AS quantity FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return _lazy(s, d, "lineitem").aggregate("l_returnflag, l_linestatus", "count(*) AS n", "CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS DOUBLE) AS quantity")


@query("lazy_aggregate_where_order_limit", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
def _(s, d):
    return _lazy(s, d, "orders").aggregate("o_custkey", where="o_orderstatus = 'F'", order_by="n DESC, o_custkey", limit=20)


@query("lazy_count", "SELECT COUNT(*) AS n FROM ecommerce")
def _(s, d):
    return _lazy(s, d, "ecommerce").query("SELECT count(*) AS n FROM data")


@query("lazy_query_sql", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type HAVING COUNT(*) > 1")
def _(s, d):
    return _lazy(s, d, "events").query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, quantile_cont(value, 0.5) AS median FROM data GROUP BY event_type HAVING count(*) > 1")


def _same_sql(name: str, tables: list[str], sql: str) -> None:
    """The same text for both engines: over the lazy view of one table, or over guarded views of several."""

    @query(name, sql)
    def _(s, d):
        if len(tables) == 1:
            return _lazy(s, d, tables[0]).query(re.sub(rf"\b(FROM|JOIN) {tables[0]}\b", r"\1 data", sql))
        text = to_spark_dialect(sql)
        check_query(s, text, tuple(tables))
        head = "WITH " + ", ".join(f"{t} AS (SELECT * FROM parquet.`{d}/{t}.parquet`)" for t in tables)
        return s.sql(f"{head}, {text[5:]}" if text.startswith("WITH ") else f"{head} {text}")


_same_sql("sql_rollup", ["orders"], "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_same_sql("sql_cube", ["lineitem"], "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_same_sql("sql_grouping_sets", ["customer"], "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
_same_sql("sql_window_rank", ["part"], "SELECT p_partkey, p_brand, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr, LAG(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part")
_same_sql("sql_range_frame", ["events"], "SELECT event_id, SUM(CAST(value AS DECIMAL(28,4))) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) > 100 AS busy FROM events")
_same_sql("sql_set_ops", ["customer", "supplier"], "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) x UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) y UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) z")
_same_sql("sql_semi_anti", ["customer", "orders"], "SELECT c_custkey, 'semi' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_same_sql("sql_outer_join", ["nation", "region", "supplier"], "SELECT n_name, r_name, COUNT(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name")
_same_sql("sql_correlated", ["part"], "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT AVG(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
_same_sql("sql_filter_agg", ["ecommerce"], "SELECT category, COUNT(*) FILTER (WHERE quantity > 1) AS several, COUNT(DISTINCT customer_id) AS customers FROM ecommerce GROUP BY category")


@query("sql_pivot", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def _(s, d):
    return _lazy(s, d, "orders").query("SELECT o_orderpriority, COALESCE(f, 0) AS f, COALESCE(o, 0) AS o, COALESCE(p, 0) AS p FROM (SELECT o_orderpriority, o_orderstatus FROM data) PIVOT (COUNT(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))")


@query("sql_unpivot", "SELECT n_nationkey, 'n_name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey")).unpivot("n_nationkey", ["n_name", "n_regionkey"], "field", "value")


@query("sql_json_scalar", "SELECT event_id, json_extract_string(props, '$.k') IS NULL AS without_k, length(props) AS props_length FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").isNull().alias("without_k"), F.length("props").cast("bigint").alias("props_length"))


@query("asof_join", "WITH r AS (SELECT user_id, ts, MAX(value) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, r.seen FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts")
def _(s, d):
    e = table(s, d, "events")
    seen = e.where(F.col("event_type") == "purchase").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return as_of_join(e.select("event_id", "user_id", "ts"), seen, "ts", ["user_id"], ["seen"]).select("event_id", "seen")


@query("lazy_sample", "SELECT LEAST(1000, COUNT(*)) AS n FROM ecommerce")
def _(s, d):
    return _lazy(s, d, "ecommerce").sample(1000).agg(F.count(F.lit(1)).alias("n"))


@query("correlation_wide")
def _(s, d):
    """Every pair of 301 columns made from orders by a hash."""
    cols = [f"c{i}" for i in range(301)]
    return Q.correlation_matrix(table(s, d, "orders").select(*[F.pmod(F.xxhash64("o_orderkey", F.lit(i % 300)), F.lit(1_000)).alias(c) for i, c in enumerate(cols)]), cols)


# --- files: each is written, read back by its suffix, and held against SQL over the table -----------------------------------


def _round_trip(s: SparkSession, df: DataFrame, suffix: str, make: Callable[[DataFrame, Path], None] | None = None) -> DataFrame:
    folder = Path(re.sub("^file:/*", "/", shared_folder(s))) / uuid4().hex
    if "://" in str(folder) and make:
        folder = Path(tempfile.mkdtemp()) / "files"  # databases are files of the driver
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"table{suffix}"
    (make or (lambda df, path: write_table(df, path)))(df, path)
    return load(path, s)[0].drop(Q.ROW_ID)


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
SUPPLIERS = ["s_suppkey", "s_name", "s_nationkey"]
for _suffix in ("csv", "json", "parquet"):

    @query(f"source_{_suffix}", f"SELECT {', '.join(ORDERS)} FROM orders")
    def _(s, d, suffix=_suffix):
        return _round_trip(s, table(s, d, "orders").select(*ORDERS), f".{suffix}").select(*ORDERS)


@query("source_xlsx", f"SELECT {', '.join(SUPPLIERS)} FROM supplier")
def _(s, d):
    return _round_trip(s, table(s, d, "supplier").select(*SUPPLIERS), ".xlsx").select(*[F.col(c).cast("bigint" if c.endswith("key") else "string").alias(c) for c in SUPPLIERS])


def _sqlite(df: DataFrame, path: Path) -> None:
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE other (x)")
        con.execute("CREATE TABLE suppliers (s_suppkey INTEGER, s_name TEXT, s_nationkey INTEGER)")
        con.executemany("INSERT INTO suppliers VALUES (?, ?, ?)", df.toLocalIterator())


def _duckdb(df: DataFrame, path: Path) -> None:
    import duckdb

    rows = df.toArrow()  # noqa: F841
    with duckdb.connect(str(path)) as con:
        con.execute("CREATE TABLE suppliers AS SELECT * FROM rows")


def _script(df: DataFrame, path: Path) -> None:
    rows = ", ".join("({}, '{}', {})".format(r[0], r[1].replace("'", "''"), r[2]) for r in df.toLocalIterator())
    path.write_text(f"-- suppliers; all of them\nCREATE TABLE s (s_suppkey BIGINT, s_name TEXT, s_nationkey BIGINT);\nINSERT INTO s VALUES {rows};\nSELECT * FROM s;\n")


for _name, _suffix, _make in (("sqlite", ".db", _sqlite), ("duckdb", ".duckdb", _duckdb), ("sql_script", ".sql", _script)):

    @query(f"source_{_name}", f"SELECT {', '.join(SUPPLIERS)} FROM supplier")
    def _(s, d, suffix=_suffix, make=_make):
        return _round_trip(s, table(s, d, "supplier").select(*SUPPLIERS), suffix, make).select(*[F.col(c).cast("bigint" if c.endswith("key") else "string").alias(c) for c in SUPPLIERS])


# --- edits ----------------------------------------------------------------------------------------------------------------

CUST = "c_custkey, c_name, c_nationkey, c_mktsegment"


def _cust(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("ops_insert", f"SELECT {CUST} FROM customer UNION ALL SELECT -1, 'new', NULL, 'NONE'")
def _(s, d):
    return D.insert_row(_cust(s, d), {"c_custkey": -1, "c_name": "new", "c_mktsegment": "NONE"})


@query("ops_update", "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_nationkey END AS c_nationkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'seen' END AS note FROM customer")
def _(s, d):
    return D.update_rows(_cust(s, d), {"c_mktsegment": "BUILDING"}, {"c_nationkey": 99, "note": "seen"})


@query("ops_delete", f"SELECT {CUST} FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey <> 3 OR c_mktsegment IS NULL OR c_nationkey IS NULL")
def _(s, d):
    return D.delete_rows(_cust(s, d), {"c_mktsegment": "BUILDING", "c_nationkey": 3})


@query("ops_upsert", f"SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'changed' ELSE c_name END AS c_name, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT -7, 'added', NULL, NULL")
def _(s, d):
    a = D.DataAsset(_cust(s, d))
    a.upsert({"c_custkey": 5, "c_name": "changed"}, "c_custkey")
    a.upsert({"c_custkey": -7, "c_name": "added"}, "c_custkey")
    return a.df


@query("ops_rollback", f"SELECT {CUST} FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(s, d):
    a = D.DataAsset(_cust(s, d))
    a.delete({"c_mktsegment": "BUILDING"})
    a.insert({"c_custkey": -1})
    a.rollback()
    return a.df


@query("ops_audit", "SELECT 'update' AS operation, COUNT(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS rows FROM customer UNION ALL SELECT 'insert', 1 UNION ALL SELECT 'delete', COUNT(*) FILTER (WHERE c_mktsegment = 'MACHINERY') FROM customer UNION ALL SELECT 'rollback', COUNT(*) + 1 FROM customer")
def _(s, d):
    """The audit log of a few edits."""
    a = D.DataAsset(_cust(s, d))
    a.update({"c_mktsegment": "BUILDING"}, {"c_nationkey": 7})
    a.insert({"c_custkey": -1})
    a.delete({"c_mktsegment": "MACHINERY"})
    a.rollback()
    return s.createDataFrame([(e["operation"], int(e.get("rows_affected", e.get("rows_after")))) for e in a.audit_log], "operation string, rows bigint")


@query("ops_match_other_kinds", f"SELECT {CUST} FROM customer WHERE c_custkey = 3")
def _(s, d):
    c = _cust(s, d)
    return c.where(D.matches(c, {"c_name": 5}) | D.matches(c, {"c_custkey": "abc"}) | D.matches(c, {"c_custkey": 3.0}))


@query("ops_match_nothing", f"SELECT {CUST} FROM customer WHERE false")
def _(s, d):
    c = _cust(s, d)
    return c.where(D.matches(c, {"no_such_column": 1}))


MERGE_KEY = {"left": "a.customer_id", "inner": "a.customer_id", "right": "b.customer_id", "outer": "COALESCE(a.customer_id, b.customer_id)"}
MERGE_SQL = """
WITH a AS (SELECT customer_id, MIN(row_id) AS row_id, COUNT(*) AS n FROM ecommerce GROUP BY 1), b AS (SELECT customer_id, MIN(row_id) AS row_id, MAX(total_orders) AS total_orders FROM customer_profile GROUP BY 1)
SELECT {key} AS customer_id, a.row_id AS row_id_x, n, b.row_id AS row_id_y, total_orders FROM a {how} JOIN b ON a.customer_id IS NOT DISTINCT FROM b.customer_id"""

for _how in MERGE_KEY:

    @query(f"ops_merge_{_how}", MERGE_SQL.format(key=MERGE_KEY[_how], how=_how if _how != "outer" else "FULL OUTER"))
    def _(s, d, how=_how):
        a = table(s, d, "ecommerce").groupBy("customer_id").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))
        b = table(s, d, "customer_profile").groupBy("customer_id").agg(F.min("row_id").alias("row_id"), F.max("total_orders").alias("total_orders"))
        return D.merge_frames(a, b, "customer_id", how)


# --- event-time windows (the batch form of streaming/windows.py) ---------------------------------------------------------------


@query("windowed_totals", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS events, {dsum('value')} AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return windowed_totals(table(s, d, "events"), "ts", ["event_type"], "value").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", "total")


@query("sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
n AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_start, COUNT(*) AS events FROM n GROUP BY user_id, k""")
def _(s, d):
    return sessions(table(s, d, "events"), "ts", "user_id").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


def answer_rows(s: SparkSession, answers: dict[str, dict]) -> DataFrame:
    """(question, available, answer); an answer that is a DataFrame has one row, a JSON object, for each of its rows."""
    schema = "question string, available boolean, answer string"
    whole = {k: v["answer"] for k, v in answers.items() if isinstance(v.get("answer"), DataFrame)}
    out = s.createDataFrame([(k, v["available"], str(v.get("answer", v.get("reason")))) for k, v in answers.items() if k not in whole], schema)
    for k, df in whole.items():
        out = out.unionByName(df.select(F.lit(k).alias("question"), F.lit(True).alias("available"), F.to_json(F.struct(*df.columns)).alias("answer")))
    return out


@query("question_answers")
def _(s, d):
    """All answers over the sales view, which has every concept, as (question, available, answer)."""
    from tallyforge.plans.analysis import AnalysisResult

    return answer_rows(s, AnalysisResult(fact(s, d), "sales").ask())


@query("question_answers_finance")
def _(s, d):
    """All answers over finance as (question, available, answer)."""
    from tallyforge.plans.analysis import AnalysisResult

    r = AnalysisResult(table(s, d, "finance").select("entry_id", "account", "revenue", "cost", "received_at"), "finance")
    return answer_rows(s, r.ask())
