"""Metrics over a table and its semantic map (concept -> column). Each function returns a tidy DataFrame.

Groups without a key are left out; sums are exact; top lists break ties by key, so they are the same on every run. Column names in
results are fixed, whatever the input columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import parse_date
from tallyforge.functions.numbers import col_num, ratio, total

PROFIT = "_derived_profit"
TOP = 10
DAILY_SPAN = 62
BAND = 5.0

Semantics = dict[str, str]


def _num(df: DataFrame, sem: Semantics, concept: str) -> Column | None:
    c = sem.get(concept)
    return col_num(df, c) if c in df.columns else None


def _key(sem: Semantics, concept: str) -> Column:
    return F.col(f"`{sem[concept]}`")


def ensure_profit(df: DataFrame, sem: Semantics) -> tuple[DataFrame, Semantics, bool]:
    """Adds revenue - cost as profit where no column is profit and both are there."""
    if "profit" in sem or "revenue" not in sem or "cost" not in sem:
        return df, sem, False
    return df.withColumn(PROFIT, col_num(df, sem["revenue"]) - col_num(df, sem["cost"])), sem | {"profit": PROFIT}, True


def kpis(df: DataFrame, sem: Semantics) -> DataFrame:
    """One row of totals; a column is there only if its concepts are. One pass, with distinct counts as the only expansion."""
    rev, cost, profit, qty, disc = (_num(df, sem, c) for c in ("revenue", "cost", "profit", "quantity", "discount"))
    if profit is None and rev is not None and cost is not None:
        profit = rev - cost
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, c in (("revenue", rev), ("cost", cost), ("profit", profit), ("quantity", qty)):
        if c is not None:
            aggs.append(total(c).alias(f"total_{name}"))
    if rev is not None:
        aggs.append(F.avg(rev).alias("mean_revenue"))
    for concept, name in (("order", "orders"), ("customer", "customers"), ("product", "products")):
        if sem.get(concept) in df.columns:
            aggs.append(F.count_distinct(_key(sem, concept)).alias(name))
    if disc is not None:
        aggs += [F.avg(disc).alias("mean_discount"), F.max(disc).alias("max_discount")]
        if rev is not None:
            aggs.append(total(rev * disc / 100).alias("discount_value"))
    out = df.agg(*aggs)
    if "orders" not in out.columns:
        out = out.withColumn("orders", F.col("rows"))
    if rev is not None:
        if profit is not None:
            out = out.withColumn("profit_margin_pct", F.round(F.when(F.col("total_revenue") != 0, 100 * F.try_divide("total_profit", "total_revenue")), 2))
        price = F.col("mean_revenue")
        if qty is not None:
            price = F.when(F.col("total_quantity") != 0, F.round(F.try_divide("total_revenue", "total_quantity"), 2)).otherwise(price)
        out = out.withColumn("average_selling_price", price).withColumn("average_order_value", F.round(F.try_divide("total_revenue", "orders"), 2))
    if disc is not None:
        out = out.withColumn("average_discount_pct", F.round("mean_discount", 2))
        if rev is not None:
            given = (F.col("max_discount") > 1) & (F.col("max_discount") <= 150) & (F.col("total_revenue") != 0)
            out = out.withColumn("total_discount_value", F.when(given, F.round("discount_value", 2)))
    return out.drop("mean_revenue", "mean_discount", "max_discount", "discount_value", "rows")


def unique_counts(df: DataFrame, sem: Semantics) -> DataFrame:
    """One row: distinct values of product, category and customer, as far as they are there."""
    return df.agg(*[F.count_distinct(_key(sem, c)).alias(n) for c, n in (("product", "unique_products"), ("category", "unique_categories"), ("customer", "unique_customers")) if sem.get(c) in df.columns])


def group_totals(df: DataFrame, sem: Semantics, concept: str) -> DataFrame:
    """(key, revenue, profit, quantity, avg_discount) per key, as far as the concepts are there. One shuffle."""
    aggs = [total(c).alias(n) for n in ("revenue", "profit", "quantity") if (c := _num(df, sem, n)) is not None]
    if (d := _num(df, sem, "discount")) is not None:
        aggs.append(F.avg(d).alias("avg_discount"))
    return df.where(_key(sem, concept).isNotNull()).groupBy(_key(sem, concept).alias("key")).agg(*(aggs or [F.count(F.lit(1)).alias("rows")]))


def top(groups: DataFrame, by: str, n: int = TOP, ascending: bool = False) -> DataFrame:
    """The n first keys by a measure, nulls last, ties by key: a bounded heap per partition."""
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return groups.orderBy(order, "key").limit(n)


def category_revenue(df: DataFrame, sem: Semantics) -> DataFrame:
    """(category, revenue, share_pct)"""
    g = group_totals(df, sem, "category")
    share = F.round(100 * F.try_divide("revenue", F.sum("revenue").over(Window.partitionBy())), 2)  # one row per category
    return g.select(F.col("key").alias("category"), "revenue", share.alias("share_pct"))


def category_margin(df: DataFrame, sem: Semantics) -> DataFrame:
    """(category, revenue, profit, margin_pct): infinite where only revenue is 0, null for 0 / 0."""
    g = group_totals(df, sem, "category")
    m = 100 * ratio(F.col("profit"), F.col("revenue"))
    return g.select(F.col("key").alias("category"), "revenue", "profit", F.when(F.abs(m) < F.lit(float("inf")), F.round(m, 2)).otherwise(m).alias("margin_pct"))


def worst_margin(df: DataFrame, sem: Semantics) -> DataFrame:
    return category_margin(df, sem).where(F.col("margin_pct").isNotNull()).orderBy("margin_pct", "category").limit(1)


def pareto(df: DataFrame, sem: Semantics, concept: str = "category") -> DataFrame:
    """(key, revenue, cumulative_pct), from the largest on."""
    g = group_totals(df, sem, concept)
    run = Window.orderBy(F.desc("revenue"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("key", "revenue", F.round(100 * F.try_divide(F.sum("revenue").over(run), F.sum("revenue").over(Window.partitionBy())), 4).alias("cumulative_pct"))


def loss_making(df: DataFrame, sem: Semantics, concept: str = "product") -> DataFrame:
    return group_totals(df, sem, concept).where(F.col("profit") < 0)


def per_customer(df: DataFrame, sem: Semantics) -> DataFrame:
    """(key, orders, revenue, profit): distinct orders per customer, or rows where nothing identifies orders."""
    orders = F.count_distinct(_key(sem, "order")) if sem.get("order") in df.columns else F.count(F.lit(1))
    aggs = [orders.alias("orders")] + [total(c).alias(n) for n in ("revenue", "profit") if (c := _num(df, sem, n)) is not None]
    return df.where(_key(sem, "customer").isNotNull()).groupBy(_key(sem, "customer").alias("key")).agg(*aggs)


def customer_summary(df: DataFrame, sem: Semantics) -> DataFrame:
    """One row: unique_customers, mean orders, repeat and one-time customers, mean revenue and profit, share of the five largest."""
    per = per_customer(df, sem)
    aggs = [F.count(F.lit(1)).alias("unique_customers"), F.avg("orders").alias("average_orders"), F.count_if(F.col("orders") > 1).alias("repeat_customers"), F.count_if(F.col("orders") == 1).alias("one_time_customers")]
    aggs += [F.avg(n).alias(f"average_{n}") for n in ("revenue", "profit") if n in per.columns]
    out = per.agg(*aggs)
    if "revenue" in per.columns:
        whole = per.agg(F.sum("revenue").alias("all_revenue"))
        five = top(per, "revenue", 5).agg(F.sum("revenue").alias("top5_revenue"))
        # three frames of one row each
        out = out.join(F.broadcast(whole)).join(F.broadcast(five)).withColumn("top5_revenue_concentration_pct", F.round(F.when(F.col("all_revenue") != 0, 100 * F.try_divide("top5_revenue", "all_revenue")), 2)).drop("all_revenue", "top5_revenue")
    return out


def dated(df: DataFrame, sem: Semantics, metric: str, *keys: str) -> DataFrame:
    """(date, value, keys...) of rows that have all of them."""
    date = parse_date(F.col(f"`{sem['date']}`"), df.schema[sem["date"]].dataType)
    return df.select(date.alias("date"), col_num(df, metric).alias("value"), *[F.col(f"`{k}`").alias("key") for k in keys]).na.drop()


def trend(df: DataFrame, sem: Semantics, metric: str, granularity: str | None = None) -> DataFrame:
    """(period, value, rolling_average) per day, or per month (labelled by its last day) where dates span more than 62 days; empty periods are 0.

    The calendar comes from the first and last period, one row; sums per period are made before anything is ordered.
    """
    rows = dated(df, sem, metric)
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    if granularity is None:
        r = span.first()
        granularity = "monthly" if r.a is not None and (r.b - r.a).days > DAILY_SPAN else "daily"
    if granularity == "daily":
        period = F.col("date").cast("date")
        calendar = span.where(F.col("a").isNotNull()).select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("period"))
    else:
        period = F.last_day("date")
        months = F.sequence(F.trunc("a", "month").cast("date"), F.trunc("b", "month").cast("date"), F.expr("interval 1 month"))
        calendar = span.where(F.col("a").isNotNull()).select(F.explode(months).alias("month")).select(F.last_day("month").alias("period"))
    sums = rows.groupBy(period.alias("period")).agg(total(F.col("value")).alias("value"))
    out = calendar.join(sums, "period", "left").select("period", F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.withColumn("rolling_average", F.avg("value").over(Window.orderBy("period").rowsBetween(-2, 0)))


def trend_changes(periods: DataFrame, monthly: bool = True) -> DataFrame:
    """One row: growth_pct (last against first), mom_pct (against the one before), yoy_pct (months only, against the 13th from the end)."""
    w = Window.orderBy("period")
    rows = periods.select("period", "value", F.first("value").over(w).alias("first"), F.lag("value", 1).over(w).alias("before"), F.lag("value", 12).over(w).alias("year_before"))
    last = rows.orderBy(F.desc("period")).limit(1)
    pct = lambda base: F.round(F.when(F.col(base) != 0, 100 * F.try_divide(F.col("value") - F.col(base), F.abs(base))), 2)
    growth = F.when(F.col("before").isNotNull(), pct("first"))
    return last.select(growth.alias("growth_pct"), pct("before").alias("mom_pct"), (pct("year_before") if monthly else F.lit(None).cast("double")).alias("yoy_pct"))


def growth(df: DataFrame, sem: Semantics, concept: str, metric: str) -> DataFrame:
    """(key, first_half, second_half, change_pct, status): halves of the time between first and last date, by one conditional aggregation."""
    rows = dated(df, sem, metric, sem[concept])
    span = rows.agg((F.min("date") + (F.max("date") - F.min("date")) / 2).alias("mid"))
    rows = rows.join(F.broadcast(span))  # one row
    zero = F.lit(0.0)
    halves = rows.groupBy("key").agg(total(F.when(F.col("date") <= F.col("mid"), F.col("value"))).alias("first_half"), total(F.when(F.col("date") > F.col("mid"), F.col("value"))).alias("second_half"))
    halves = halves.where((F.col("first_half") != 0) | (F.col("second_half") != 0))
    change = F.when(F.col("first_half") != 0, F.round(100 * F.try_divide(F.col("second_half") - F.col("first_half"), F.abs("first_half")), 2)).otherwise(F.when(F.col("second_half") > 0, 100.0).otherwise(zero))
    return halves.withColumn("change_pct", change).withColumn("status", F.when(change > BAND, "growing").when(change < -BAND, "declining").otherwise("flat"))
