"""Tables in plain text."""

from __future__ import annotations

from collections.abc import Sequence

from tallyforge.reporting.html import fmt

#: Headers with one of these words are set right.
RIGHT = ("value", "revenue", "profit", "quantity", "count", "share", "discount", "#", "%")


def render_table(headers: Sequence[str], rows: Sequence[Sequence], title: str | None = None) -> str:
    text = [[str(h) for h in headers], *([fmt(v) for v in r] for r in rows)]
    widths = [max(len(r[i]) for r in text) for i in range(len(headers))]
    right = [any(w in h.lower() for w in RIGHT) for h in headers]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r, head=False: "| " + " | ".join(v.rjust(w) if ri and not head else v.ljust(w) for v, w, ri in zip(r, widths, right)) + " |"
    return "\n".join([*([title] if title else []), rule, line(text[0], True), rule, *(line(r) for r in text[1:]), *([rule] if rows else [])])


def terminal_report(result) -> str:
    from tallyforge.plans.analysis import shown

    p, q = result.profile, result.quality()
    out = [f"Analysis of {result.source}"]
    overview = [["Rows", p["rows"]], ["Columns", p["columns"]], ["Size (KB)", round(p["memory_bytes"] / 1024, 1)], ["Missing values", q["missing"]["total_missing"]], ["Duplicate rows", q["duplicates"]["duplicate_rows"]], ["Numeric columns", len(p["numeric_columns"])], ["Categorical columns", len(p["categorical_columns"])], ["Date columns", len(p["date_columns"])], ["Quality score", f"{q['quality_score']}/100"], ["Encoding", result.load_meta.get("encoding", "utf-8")]]
    out.append(render_table(["Metric", "Value"], overview, "DATASET"))
    out.append(render_table(["KPI", "Value"], [[k.replace("_", " ").title(), v] for k, v in result.kpis().items()], "KPIS"))
    cat, prod = result.categories(), result.products()
    if (by_category := cat.get("revenue_by_category")) is not None:
        rows, cut = shown(by_category, 10)
        if rows:
            out.append(render_table(["Category", "Revenue", "Share %"], [list(r.values()) for r in rows], "REVENUE BY CATEGORY" + (f" ({cut})" if cut else "")))
    if rows := prod.get("top_products_by_quantity"):
        out.append(render_table(["#", "Product", "Quantity"], [[i, *r.values()] for i, r in enumerate(rows, 1)], "PRODUCTS BY QUANTITY"))
    if rows := prod.get("highest_discount_products"):
        out.append(render_table(["#", "Product", "Discount %"], [[i, *r.values()] for i, r in enumerate(rows, 1)], "PRODUCTS BY DISCOUNT"))
    if by := q["outliers"]["by_column"]:
        out.append(render_table(["Column", "Outlier count"], sorted(by.items(), key=lambda x: -x[1]), "OUTLIERS"))
    if found := result.insights():
        out.append(render_table(["Severity", "Finding"], [[f.get("severity", ""), f.get("title", "")] for f in found[:10]], "FINDINGS"))
    if recs := result.recommendations():
        out.append(render_table(["#", "Recommendation"], list(enumerate(recs[:10], 1)), "RECOMMENDATIONS"))
    return "\n\n".join(out)
