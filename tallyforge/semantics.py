"""Business meaning of columns from their names and types; driver-side only."""

from __future__ import annotations

import re

# Names that decide a column's meaning, and the order in which meanings are given out.
KEYWORDS: dict[str, list[str]] = {
    "revenue": ["revenue", "sales_amount", "sales", "amount", "gmv", "turnover", "net_sales", "total_sales", "grand_total", "line_total", "sale_amount", "total_amount", "order_value", "order_total", "net_amount", "gross_sales", "sales_value"],
    "profit": ["profit", "net_profit", "gross_profit", "profit_amount", "margin_amount", "net_income", "earnings", "profit_value"],
    "cost": ["cost", "cogs", "cost_price", "purchase_cost", "unit_cost", "cost_amount", "buying_price", "purchase_price", "cogs_amount"],
    "quantity": ["quantity", "qty", "units", "units_sold", "unit_count", "qty_sold", "no_of_units", "units_purchased", "order_qty"],
    "customer": ["customer_id", "customer", "buyer_id", "buyer", "client_id", "user_id", "cust_id", "member_id", "account_id", "customer_name", "client_name"],
    "product": ["product_id", "product_name", "product", "item", "sku", "item_name", "name", "product_title", "item_code", "product_code"],
    "category": ["category", "segment", "department", "product_category", "product_type", "sub_category", "subcategory", "product_group"],
    "date": ["date", "order_date", "transaction_date", "created_at", "timestamp", "order_time", "invoice_date", "order_dt", "txn_date", "purchase_date", "created_date", "datetime"],
    "discount": ["discount_pct", "discount_percent", "discount", "disc_pct", "disc_percent"],
    "order": ["order_id", "transaction_id", "invoice_id", "invoice_no", "order_no", "order_number", "txn_id", "receipt_no", "receipt_id", "bill_no", "bill_id"],
    "price": ["unit_price", "selling_price", "price", "rate", "mrp", "list_price", "retail_price", "sale_price"],
}
PRIORITY = ["order", "customer", "product", "category", "date", "discount", "cost", "profit", "revenue", "quantity", "price"]
NUMERIC_CONCEPTS = {"discount", "cost", "profit", "revenue", "quantity", "price"}

_BOUNDARY = re.compile(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])")


def normalise_name(name: object) -> str:
    """Snake case in lower letters: word boundaries of camel case, blanks and hyphens become ``_``."""
    text, before = str(name).strip(), None
    while text != before:
        before, text = text, _BOUNDARY.sub(lambda m: f"{m[1] or m[3]}_{m[2] or m[4]}", text, count=1)
    return re.sub(r"[\s\-]+", "_", text).lower()


def match_score(name: str, concept: str) -> int:
    """100 for a keyword itself, 80 for one at an end set off by ``_``, 50 for one inside, else 0."""
    best = 0
    for word in KEYWORDS[concept]:
        if name == word:
            return 100
        if name.startswith(f"{word}_") or name.endswith(f"_{word}"):
            best = max(best, 80)
        elif word in name:
            best = max(best, 50)
    return best


def fits(concept: str, label: str) -> bool:
    if concept == "date":
        return label in ("date", "datetime")
    return not (concept in NUMERIC_CONCEPTS and label == "categorical")


def detect_semantics(labels: dict[str, str]) -> dict[str, str]:
    """Concept -> column. ``labels`` gives each column's type label, in schema order.

    The best-scoring free column gets a concept, the first one on ties; if its type doesn't fit, the concept stays without a column and the
    column stays free.
    """
    found: dict[str, str] = {}
    for concept in PRIORITY:
        free = [c for c in labels if c not in found.values()]
        scored = [(match_score(normalise_name(c), concept), -i, c) for i, c in enumerate(free)]
        score, _, column = max(scored, default=(0, 0, None))
        if score and fits(concept, labels[column]):
            found[concept] = column
    return found
