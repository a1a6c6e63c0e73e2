"""Dashboard, report and chart pages as plain HTML with inline SVG; every value from the data is escaped."""

from __future__ import annotations

import json
from html import escape

from tallyforge.sources.writers import plain

STYLE = "body{font-family:sans-serif;margin:2em;color:#1f2937}.cards,.grid{display:flex;flex-wrap:wrap;gap:1em}.card,.chart{border:1px solid #d1d5db;border-radius:8px;padding:1em}.card b{display:block;font-size:1.4em}table{border-collapse:collapse}td,th{border:1px solid #d1d5db;padding:.3em .6em;text-align:left}small{color:#6b7280}"
#: Rows of a chart shown as a table.
TABLE_ROWS = 60
COLOURS = ["#2563eb", "#f59e0b", "#16a34a", "#dc2626"]
W, H = 460, 220


def fmt(v, decimals: int = 2) -> str:
    return "-" if v is None else f"{v:,.{decimals}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


def page(title: str, body: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def html_table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape(fmt(v))}</{tag}>" for v in row)
    return f"<table><tr>{cells('th', head)}</tr>{''.join(f'<tr>{cells("td", r)}</tr>' for r in rows)}</table>"


def svg(chart) -> str:
    """Bars, lines and points of a chart; other kinds are shown as a table."""
    if chart.empty:
        return f"<p>{escape(chart.note)}</p>"
    if chart.kind not in ("line", "column", "bar", "pareto", "scatter"):
        head, rows = (list(chart.series[0]), [list(s.values()) for s in chart.series]) if "x" not in chart.series[0] else (["label", "value"], [list(p) for p in zip(chart.series[0]["x"], chart.series[0]["y"])])
        return html_table(head, rows[:TABLE_ROWS]) + (f"<p>The first {TABLE_ROWS} of {len(rows):,} rows.</p>" if len(rows) > TABLE_ROWS else "")
    shapes = []
    for i, s in enumerate(chart.series):
        ys = [float(v) if v is not None else 0.0 for v in s["y"]]
        lo, hi = min([0.0, *ys]), max([0.0, *ys]) or 1.0
        at = lambda v, lo=lo, hi=hi: H - 20 - (H - 40) * (v - lo) / ((hi - lo) or 1)
        step = (W - 20) / max(1, len(ys))
        colour = COLOURS[i % len(COLOURS)]
        if chart.kind == "scatter":
            xs = [float(v) for v in s["x"]]
            a, b = min(xs), max(xs)
            shapes += [f"<circle cx='{10 + (W - 20) * (x - a) / ((b - a) or 1):.1f}' cy='{at(y):.1f}' r='2' fill='{colour}' fill-opacity='.5'/>" for x, y in zip(xs, ys)]
        elif chart.kind == "line" or i:
            points = " ".join(f"{10 + step * (j + 0.5):.1f},{at(y):.1f}" for j, y in enumerate(ys))
            shapes.append(f"<polyline points='{points}' fill='none' stroke='{colour}' stroke-width='2'/>")
        else:
            for j, y in enumerate(ys):
                top, low = min(at(y), at(0)), max(at(y), at(0))
                shapes.append(f"<rect x='{10 + step * j:.1f}' y='{top:.1f}' width='{max(1.0, step * 0.8):.1f}' height='{low - top:.1f}' fill='{colour}'><title>{escape(str(s['x'][j]))}: {fmt(y)}</title></rect>")
    return f"<svg viewBox='0 0 {W} {H}' width='{W}' height='{H}' role='img'>{''.join(shapes)}</svg>"


def chart_block(chart) -> str:
    facts = " · ".join(f"{k.replace('_', ' ')}: {v}" for k, v in chart.to_meta().items() if v and k not in ("key", "title"))
    return f"<div class='chart' id='{escape(chart.key)}'><h3>{escape(chart.title)}</h3>{svg(chart)}<br><small>{escape(facts)}</small></div>"


def chart_page(chart) -> str:
    data = json.dumps(plain({"meta": chart.to_meta(), "kind": chart.kind, "series": chart.series}), ensure_ascii=False).replace("<", "\\u003c")
    return page(chart.title, chart_block(chart) + f"<script type='application/json' id='figure'>{data}</script>")


def _cards(result, currency: str) -> str:
    k = result.kpis()
    shown = [("total_revenue", "Total revenue", currency, ""), ("total_profit", "Total profit", currency, ""), ("profit_margin_pct", "Profit margin", "", "%"), ("orders", "Orders", "", ""), ("customers", "Customers", "", ""), ("total_quantity", "Quantity", "", "")]
    return "<div class='cards'>" + "".join(f"<div class='card'>{label}<b>{escape(pre + fmt(k.get(c)) + (post if k.get(c) is not None else ''))}</b></div>" for c, label, pre, post in shown) + "</div>"


def _findings(result) -> str:
    return "".join(f"<div class='card'><b>{escape(str(f.get('title', '')))}</b>{escape(str(f.get('severity', '')))}: {escape(str(f.get('evidence', '')))} {escape(str(f.get('recommendation', '')))}</div>" for f in result.insights())


def dashboard_html(result, currency: str = "") -> str:
    charts = "".join(chart_block(c) for c in result.visualize())
    return page(f"Dashboard: {result.source}", f"{_cards(result, currency)}<h2>Charts</h2><div class='grid'>{charts}</div><h2>Findings</h2>{_findings(result) or '<p>None.</p>'}")


def report_html(result, currency: str = "") -> str:
    p, q = result.profile, result.quality()
    overview = html_table(["Metric", "Value"], [["Rows", p["rows"]], ["Columns", p["columns"]], ["Missing values", q["missing"]["total_missing"]], ["Duplicate rows", q["duplicates"]["duplicate_rows"]], ["Quality score", q["quality_score"]]])
    kpis = html_table(["KPI", "Value"], [[k.replace("_", " "), v] for k, v in result.kpis().items()])
    types = html_table(["Column", "Type"], [[c, t] for c, t in p["dtypes"].items()])
    return page(f"Report: {result.source}", f"{_cards(result, currency)}<h2>Overview</h2>{overview}<h2>KPIs</h2>{kpis}<h2>Columns</h2>{types}<h2>Findings</h2>{_findings(result) or '<p>None.</p>'}")
