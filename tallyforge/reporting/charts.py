"""Chart specifications: aggregated rows plus a JSON figure; no plotting package is needed."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.errors import NoTrendData
from tallyforge.operators import metrics as M
from tallyforge.operators import quality as Q

EMPTY = "Not enough data for this visualization."


@dataclass
class ChartSpec:
    key: str
    title: str
    kind: str
    series: list[dict] = field(default_factory=list)
    x_axis: str = ""
    y_axis: str = ""
    metric: str = ""
    aggregation: str = ""
    dimension: str = ""
    note: str = ""

    def to_meta(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("series", "kind")}

    @property
    def empty(self) -> bool:
        return not self.series


def top_products_chart(df: DataFrame, sem: dict[str, str]) -> DataFrame:
    """(product, revenue): the bars of the ten products with the most revenue, the largest first."""
    return M.top(M.group_totals(df, sem, "product"), "revenue").select(F.col("key").alias("product"), "revenue")


def build_charts(result) -> list[ChartSpec]:
    """kpi_cards, performance_trend, five charts of revenue by category, product_bar, revenue_distribution, boxplot, revenue_vs_profit and correlation_heatmap."""
    from tallyforge.plans.analysis import shown

    df, sem, k = result.cleaned_df, result.semantics, result.kpis()
    out = []
    cards = [("total_revenue", "Revenue"), ("total_profit", "Profit"), ("profit_margin_pct", "Profit Margin"), ("orders", "Orders"), ("customers", "Customers"), ("total_quantity", "Quantity")]
    out.append(ChartSpec("kpi_cards", "KPI Cards", "cards", [{"label": n, "value": k[c]} for c, n in cards if c in k], metric="Multiple KPIs", aggregation="SUM/COUNT"))
    try:
        t = result.trends()
        lines = [{"name": t["metric_label"], "x": t["periods"], "y": t["values"]}, {"name": "Rolling average (3)", "x": t["periods"], "y": t["rolling_average"]}]
        out.append(ChartSpec("performance_trend", t["title"], "line", lines, t["date_column"], t["metric_label"], t["metric_label"], "SUM", t["date_column"]))
    except NoTrendData as e:
        out.append(ChartSpec("performance_trend", "Performance Trend", "line", note=str(e)))
    by_category = result.categories().get("revenue_by_category")
    rows, cut = shown(by_category) if by_category is not None else ([], "")
    x, y = [r["category"] for r in rows], [r["revenue"] for r in rows]
    c = sem.get("category", "")
    for key, title, kind in (("revenue_by_category_column", "Revenue by Category", "column"), ("revenue_by_category_bar", "Revenue by Category", "bar"), ("category_pie", "Revenue Share by Category", "pie"), ("category_donut", "Revenue Share by Category", "donut")):
        out.append(ChartSpec(key, title, kind, [{"name": "Revenue", "x": x, "y": y}] if rows else [], c, "Total Revenue", "Revenue", "SUM", c, cut))
    pareto, cut = shown(M.pareto(df, sem).orderBy(F.desc("revenue"), "key")) if result.has("category", "revenue") else ([], "")
    series = [{"name": "Revenue", "x": [r["key"] for r in pareto], "y": [r["revenue"] for r in pareto]}, {"name": "Cumulative %", "x": [r["key"] for r in pareto], "y": [r["cumulative_pct"] for r in pareto]}]
    out.append(ChartSpec("pareto_category", "Revenue Pareto by Category", "pareto", series if pareto else [], c, "Total Revenue / Cumulative %", "Revenue", "SUM", c, cut))
    top = [r.asDict() for r in top_products_chart(df, sem).collect()] if result.has("product", "revenue") else []
    out.append(ChartSpec("product_bar", "Top 10 Products by Revenue", "bar", [{"name": "Revenue", "x": [r["product"] for r in top], "y": [r["revenue"] for r in top]}] if top else [], "Total Revenue", sem.get("product", ""), "Revenue", "SUM", sem.get("product", "")))
    r = sem.get("revenue", "")
    bins = [b.asDict() for b in Q.histogram(df, r).orderBy("bin").collect()] if result.has("revenue") else []
    out.append(ChartSpec("revenue_distribution", "Revenue Distribution", "column", [{"name": r, "x": [b["low"] for b in bins], "y": [b["frequency"] for b in bins]}] if bins else [], r, "Frequency", r, "COUNT", r))
    box = [b.asDict() for b in Q.box_summary(df, r).collect()] if result.has("revenue") else []
    out.append(ChartSpec("boxplot", "Revenue Box Plot", "box", box, "", r, r, "DISTRIBUTION"))
    points = []
    if result.has("revenue", "profit"):  # the rows with the smallest hashes: the same ones on every run
        both = df.select(Q.col_num(df, r).alias("x"), Q.col_num(df, sem["profit"]).alias("y"), F.xxhash64(Q.ROW_ID).alias("h")).na.drop()
        got = both.orderBy("h").limit(5_000).collect()
        points = [{"name": "Rows", "x": [p.x for p in got], "y": [p.y for p in got]}]
    out.append(ChartSpec("revenue_vs_profit", "Revenue vs Profit", "scatter", points, r, sem.get("profit", ""), "Revenue vs Profit", "RAW", note="At most 5,000 rows, chosen by hash." if points else ""))
    numeric = Q.numeric_columns(result.cleaned_labels)
    cells = [p.asDict() for p in Q.correlation_matrix(df, numeric).collect()] if len(numeric) >= 2 else []
    out.append(ChartSpec("correlation_heatmap", "Correlation Heatmap", "heatmap", cells, metric="Correlation", aggregation="PEARSON"))
    for s in out:
        if s.empty and not s.note:
            s.note = EMPTY
    return out
