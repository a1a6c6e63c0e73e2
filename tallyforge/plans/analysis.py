"""Whole analysis of one table: every result is a lazily computed property, each backed by its own aggregate job over one cached plan."""

from __future__ import annotations

import math
from functools import cached_property
from pathlib import Path
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.errors import EmptyDataset, NoCustomerIdentifier, NoTrendData
from tallyforge.operators import metrics as M
from tallyforge.operators import quality as Q
from tallyforge.operators.cleaning import clean
from tallyforge.semantics import detect_semantics

#: Groups shown in reports and charts; a table keeps all of them in its DataFrame.
SHOWN_GROUPS = 1_000
SCATTER_POINTS = 5_000


class InsightProvider(Protocol):
    """Anything with ``generate(context) -> list of findings``; a finding has severity, title, evidence, impact and recommendation."""

    def generate(self, context: dict) -> list[dict]: ...


class NoInsights:
    """Default: judging numbers is a business rule and left to the caller's provider."""

    def generate(self, context: dict) -> list[dict]:
        return []


def by_severity(findings: list[dict]) -> list[dict]:
    order = ["HIGH", "MEDIUM", "LOW"]
    return sorted(findings, key=lambda f: order.index(f["severity"]) if f.get("severity") in order else len(order))


def recommendations(findings: list[dict]) -> list[str]:
    """Each recommendation once, in order."""
    return list(dict.fromkeys(f["recommendation"] for f in findings if f.get("recommendation")))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def shown(df: DataFrame, limit: int = SHOWN_GROUPS) -> tuple[list[dict], str]:
    """At most ``limit`` first rows for charts and reports, and a mark that says so if there are more."""
    rows = _rows(df.limit(limit + 1))
    return rows[:limit], f"The first {limit:,} of {df.count():,} rows." if len(rows) > limit else ""


def printable(answers: dict[str, dict]) -> dict[str, dict]:
    """Answers with the first rows in place of whole DataFrames."""
    out = {}
    for k, v in answers.items():
        if isinstance(v.get("answer"), DataFrame):
            rows, cut = shown(v["answer"])
            v = v | {"answer": rows} | ({"cut": cut} if cut else {})
        out[k] = v
    return out


class AnalysisResult:
    def __init__(self, df: DataFrame, source: str = "", load_meta: dict | None = None, insight_provider: InsightProvider | None = None):
        # read once; later steps come from what is kept, in memory or on the executors' disks
        df = Q.with_row_id(Q.flatten(df)).persist(StorageLevel.MEMORY_AND_DISK)
        if not df.limit(1).count():
            df.unpersist()
            raise EmptyDataset()
        self.source, self.load_meta = source, load_meta or {}
        self._provider = insight_provider or NoInsights()
        self.raw_df = df
        self.dtypes = Q.detect_types(df)
        with_profit, self.semantics, self.profit_derived = M.ensure_profit(df, detect_semantics(self.dtypes))
        self.cleaned_df, self.cleaning_log = clean(with_profit, self.semantics, StorageLevel.MEMORY_AND_DISK)
        df.unpersist()

    def close(self) -> None:
        self.raw_df.unpersist()
        self.cleaned_df.unpersist()

    def has(self, *concepts: str) -> bool:
        return all(self.semantics.get(c) in self.cleaned_df.columns for c in concepts)

    @cached_property
    def cleaned_labels(self) -> dict[str, str]:
        return Q.detect_types(self.cleaned_df)

    @cached_property
    def profile(self) -> dict:
        return Q.full_profile(self.cleaned_df, self.semantics, self.cleaned_labels, distinct=True)

    @cached_property
    def _kpis(self) -> dict:
        return {k: v for k, v in M.kpis(self.cleaned_df, self.semantics).first().asDict().items() if v is not None or k == "total_discount_value"}

    def kpis(self) -> dict:
        return self._kpis

    def quality(self) -> dict:
        return self.profile["quality"]

    def statistics(self) -> dict:
        cols = Q.numeric_columns(self.cleaned_labels)
        return {r.pop("column_name"): r for r in _rows(Q.describe(self.cleaned_df, cols))} if cols else {}

    @property
    def metric(self) -> str | None:
        for c in ("revenue", "profit", "cost", "quantity"):
            if self.has(c):
                return self.semantics[c]
        return next(iter(Q.numeric_columns(self.cleaned_labels)), None)

    @cached_property
    def _trend(self) -> dict:
        if not self.has("date") or self.metric is None:
            raise NoTrendData([self.semantics[c] for c in ("date",) if c in self.semantics])
        rows = M.dated(self.cleaned_df, self.semantics, self.metric)
        r = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        if r.a is None or r.a == r.b:
            raise NoTrendData([self.semantics["date"]])
        granularity = "monthly" if (r.b - r.a).days > M.DAILY_SPAN else "daily"
        periods = M.trend(self.cleaned_df, self.semantics, self.metric, granularity)
        points = periods.orderBy("period").collect()
        changes = M.trend_changes(periods, granularity == "monthly").first().asDict()
        label = next((c.capitalize() for c in ("revenue", "profit", "cost", "quantity") if self.semantics.get(c) == self.metric), self.metric)
        return {
            "date_column": self.semantics["date"], "metric_column": self.metric, "metric_label": label, "granularity": granularity, "title": f"{granularity.capitalize()} {label} Trend",
            "periods": [p.period.isoformat() for p in points], "values": [p.value for p in points], "rolling_average": [p.rolling_average for p in points], **changes,
        }

    def trends(self) -> dict:
        return self._trend

    @cached_property
    def _categories(self) -> dict:
        if not self.has("category"):
            return {"available": False, "reason": "no category column"}
        df, sem = self.cleaned_df, self.semantics
        g = M.group_totals(df, sem, "category")
        out: dict = {"available": True, "category_column": sem["category"], "unique_categories": g.count()}
        if self.has("revenue"):
            out["revenue_by_category"] = M.category_revenue(df, sem).orderBy(F.desc_nulls_last("revenue"), "category")
            if best := out["revenue_by_category"].first():
                out |= {"top_category": best["category"], "top_category_revenue_share_pct": best["share_pct"]}
        if self.has("profit"):
            out["profit_by_category"] = g.select(F.col("key").alias("category"), "profit").orderBy(F.desc_nulls_last("profit"), "category")
        if self.has("revenue", "profit"):
            m = M.category_margin(df, sem).where(F.col("margin_pct").isNotNull())
            out["margin_by_category"] = m.select("category", "margin_pct").orderBy("margin_pct", "category")
            worst = M.worst_margin(df, sem).select("category", "margin_pct").first()
            out["worst_margin_category"] = worst.asDict() if worst else None
        return out

    def categories(self) -> dict:
        return self._categories

    @cached_property
    def _products(self) -> dict:
        if not self.has("product"):
            return {"available": False, "reason": "no product column"}
        g = M.group_totals(self.cleaned_df, self.semantics, "product").persist(StorageLevel.MEMORY_AND_DISK)
        out: dict = {"available": True, "product_column": self.semantics["product"], "unique_products": g.count()}

        def first(by: str, ascending: bool = False) -> list[dict]:
            return [{"product": r["key"], by: r[by]} for r in _rows(M.top(g, by, ascending=ascending))]

        if self.has("revenue"):
            out["top_products_by_revenue"] = first("revenue")
        if self.has("quantity"):
            out["top_products_by_quantity"] = first("quantity")
        if self.has("profit"):
            losing = M.loss_making(self.cleaned_df, self.semantics)
            out |= {
                "top_products_by_profit": first("profit"), "bottom_products_by_profit": first("profit", True)[::-1], "loss_making_product_count": g.where(F.col("profit") < 0).count(),
                "loss_making_products": losing.select(F.col("key").alias("product"), "profit").orderBy("profit", "product"),
            }
        if self.has("discount"):
            out["highest_discount_products"] = [{"product": r["key"], "avg_discount": r["avg_discount"]} for r in _rows(M.top(g, "avg_discount"))]
        g.unpersist()
        return out

    def products(self) -> dict:
        return self._products

    @cached_property
    def _customers(self) -> dict:
        if not self.has("customer"):
            raise NoCustomerIdentifier()
        out = M.customer_summary(self.cleaned_df, self.semantics).first().asDict()
        if self.has("revenue"):
            per = M.per_customer(self.cleaned_df, self.semantics)
            pick = lambda up: [{"customer": r["key"], "revenue": r["revenue"]} for r in _rows(M.top(per, "revenue", ascending=up))]
            out |= {"top_customers": pick(False), "bottom_customers": pick(True)}
        return out

    def customers(self) -> dict:
        return self._customers

    @cached_property
    def _growth(self) -> dict:
        metric = next((self.semantics[c] for c in ("revenue", "profit", "quantity") if self.has(c)), None)
        out = {}
        for dim in ("product", "category"):
            if metric is None or not self.has("date", dim):
                out[dim] = {"available": False, "reason": "needs a date, a metric and a " + dim}
                continue
            g = M.growth(self.cleaned_df, self.semantics, dim, metric).persist(StorageLevel.MEMORY_AND_DISK)
            cut = lambda s, o, g=g: _rows(g.where(F.col("status") == s).select("key", "change_pct").orderBy(o, "key").limit(M.TOP))
            out[dim] = {"available": True, "metric": metric, "growing": cut("growing", F.desc("change_pct")), "declining": cut("declining", F.asc("change_pct")), "flat_count": g.where(F.col("status") == "flat").count()}
            g.unpersist()
        return out

    def growth(self) -> dict:
        return self._growth

    @cached_property
    def _anomalies(self) -> dict:
        numeric = [c for c in Q.numeric_columns(self.dtypes) if c in self.cleaned_df.columns]
        return Q.anomalies(self.cleaned_df, numeric)

    def anomalies(self) -> dict:
        return self._anomalies

    def _or_none(self, get, error):
        try:
            return get()
        except error:
            return None

    @cached_property
    def _insights(self) -> list[dict]:
        context = {
            "kpis": self.kpis(), "quality": self.quality(), "category": self.categories(), "product": self.products(),
            "trend": self._or_none(self.trends, NoTrendData), "customer": self._or_none(self.customers, NoCustomerIdentifier),
        }
        return by_severity(self._provider.generate(context))

    def insights(self) -> list[dict]:
        return self._insights

    def recommendations(self) -> list[str]:
        return recommendations(self.insights())

    def semantic_map(self) -> dict:
        return dict(self.semantics)

    def ask(self, question: str | None = None) -> dict:
        """Looks a figure up; without a question all answers. An unknown question is unavailable, not an error. Answers that are lists of any length are DataFrames."""
        from tallyforge.plans.questions import answers

        every = answers(self)
        if question is None:
            return {k: v() for k, v in every.items()}
        return every[question]() if question in every else {"available": False, "reason": f"unknown question {question!r}"}

    def visualize(self) -> list:
        from tallyforge.reporting.charts import build_charts

        return build_charts(self)

    def summary(self) -> str:
        p, q = self.profile, self.quality()
        facts = [
            ("Dataset", self.source), ("Rows", f"{p['rows']:,}"), ("Columns", p["columns"]), ("Missing values", f"{q['missing']['total_missing']:,}"), ("Duplicate rows", f"{q['duplicates']['duplicate_rows']:,}"),
            ("Numeric columns", len(p["numeric_columns"])), ("Categorical columns", len(p["categorical_columns"])), ("Date columns", len(p["date_columns"])), ("Data quality score", f"{q['quality_score']}/100"),
        ]
        facts += [(k.replace("_", " ").title(), f"{v:,.2f}" if isinstance(v, float) and math.isfinite(v) else v) for k, v in self.kpis().items()]
        return "\n".join(["Analysis summary", *(f"{a}: {b}" for a, b in facts)])

    def table(self) -> str:
        from tallyforge.reporting.terminal import terminal_report

        return terminal_report(self)

    def print_table(self) -> None:
        print(self.table())

    def print_terminal_summary(self) -> None:
        print(self.summary())

    def dashboard(self, path: str | Path = "analysis/dashboard.html") -> Path:
        from tallyforge.reporting.html import dashboard_html
        from tallyforge.sources.writers import write_with_fallback

        target = Path(path)
        target = target if target.suffix.lower() == ".html" else target / "dashboard.html"
        return write_with_fallback(target, lambda p: p.write_text(dashboard_html(self), encoding="utf-8"))

    def export(self, directory: str | Path = "analysis") -> dict[str, Path]:
        """Cleaned data and loss-making products as Parquet folders and one JSON file per result."""
        from tallyforge.plans.questions import answers
        from tallyforge.sources.writers import save_json, write_table

        d = Path(directory)
        d.mkdir(parents=True, exist_ok=True)
        out = {"cleaned_data": write_table(self.cleaned_df.drop(Q.ROW_ID), d / "cleaned_data.parquet", single_file=False)}
        parts = {"insights": self.insights, "quality": self.quality, "statistics": self.statistics, "kpis": self.kpis, "growth": self.growth, "anomalies": self.anomalies, "business_questions": lambda: printable({k: v() for k, v in answers(self).items()})}
        if (losing := self.products().get("loss_making_products")) is not None:
            out["loss_making_products"] = write_table(losing, d / "loss_making_products.parquet", single_file=False)
        return out | {k: save_json(d / f"{k}.json", get()) for k, get in parts.items()}

    def report(self, directory: str | Path = "analysis") -> dict[str, Path]:
        from tallyforge.reporting.html import chart_page, report_html
        from tallyforge.reporting.pdf import write_pdf
        from tallyforge.sources.writers import write_with_fallback

        d = Path(directory)
        out = self.export(d) | {"dashboard": self.dashboard(d / "dashboard.html")}
        out["html_report"] = write_with_fallback(d / "report.html", lambda p: p.write_text(report_html(self), encoding="utf-8"))
        out["pdf_report"] = write_with_fallback(d / "report.pdf", lambda p: write_pdf(p, self.table().splitlines()))
        for c in self.visualize():
            out[f"chart_{c.key}"] = write_with_fallback(d / "charts" / f"{c.key}.html", lambda p, c=c: p.write_text(chart_page(c), encoding="utf-8"))
        return out

    def __repr__(self) -> str:
        return f"AnalysisResult({self.source!r}, {len(self.dtypes)} columns)"


def analyze(path: str | Path, insight_provider: InsightProvider | None = None, verbose: bool = True, spark: SparkSession | None = None) -> AnalysisResult:
    from tallyforge.sources.loaders import load

    df, meta = load(path, spark)
    result = AnalysisResult(df, Path(path).name, meta, insight_provider)
    if verbose:
        result.print_table()
    return result


def _raw(path, spark):
    from tallyforge.sources.loaders import load

    df, _ = load(path, spark)
    labels = Q.detect_types(df)
    return df, labels, detect_semantics(labels)


def profile(path: str | Path, spark: SparkSession | None = None) -> dict:
    """Profile of the data as delivered, uncleaned."""
    df, labels, sem = _raw(path, spark)
    return Q.full_profile(df, sem, labels)


def quality_check(path: str | Path, spark: SparkSession | None = None) -> dict:
    df, labels, sem = _raw(path, spark)
    return Q.quality(df, sem, labels)


def clean_file(path: str | Path, spark: SparkSession | None = None) -> DataFrame:
    df, _, sem = _raw(path, spark)
    return clean(df, sem)[0].drop(Q.ROW_ID)
