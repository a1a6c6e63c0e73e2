"""Questions answered by looking a computed figure up. Questions that judge a figure are business rules and have no entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyforge.errors import NoCustomerIdentifier


def _found(value, reason: str) -> dict:
    return {"available": False, "reason": reason} if value is None or (value.isEmpty() if isinstance(value, DataFrame) else value == []) else {"available": True, "answer": value}


def answers(result) -> dict[str, Callable[[], dict]]:
    def kpi(key):
        return lambda: _found(result.kpis().get(key), f"no {key}")

    def first(get, key):
        def one():
            value = get().get(key)
            if isinstance(value, DataFrame):
                value = [r.asDict() for r in value.take(1)]
            return _found(next(iter(value or []), None), f"no {key}")

        return one

    def part(get, key):
        return lambda: _found(get().get(key), f"no {key}")

    def customer(key, n=None):
        def get():
            try:
                value = result.customers().get(key)
            except NoCustomerIdentifier as e:
                return {"available": False, "reason": str(e)}
            return _found(value[:n] if n and value else value, f"no {key}")

        return get

    def grown(dim, key):
        return lambda: {"available": True, "answer": g[key]} if (g := result.growth()[dim])["available"] else {"available": False, "reason": g["reason"]}

    def per_order():
        k = result.kpis()
        return _found(round(k["total_quantity"] / k["orders"], 2) if "total_quantity" in k and k.get("orders") else None, "no quantity or orders")

    def most_sold():
        p = result.products()
        return _found(next(iter(p.get("top_products_by_quantity") or p.get("top_products_by_revenue") or []), None), "no product figures")

    def discount():
        k = result.kpis()
        return _found(k.get("total_discount_value") or k.get("average_discount_pct"), "no discount column")

    return {
        "how_many_customers_bought_products": customer("unique_customers"), "how_many_unique_customers": customer("unique_customers"), "how_many_orders": kpi("orders"),
        "how_many_products_sold": kpi("products"), "which_product_sells_the_most": most_sold, "which_product_generates_the_most_revenue": first(result.products, "top_products_by_revenue"),
        "which_product_generates_the_highest_profit": first(result.products, "top_products_by_profit"), "which_category_generates_the_most_revenue": first(result.categories, "revenue_by_category"),
        "which_category_generates_the_highest_profit": first(result.categories, "profit_by_category"), "which_category_has_the_worst_margin": part(result.categories, "worst_margin_category"),
        "how_much_revenue_was_generated": kpi("total_revenue"), "how_much_profit_was_generated": kpi("total_profit"), "what_is_the_profit_margin": kpi("profit_margin_pct"),
        "what_is_the_average_order_value": kpi("average_order_value"), "what_is_the_average_selling_price": kpi("average_selling_price"), "what_is_the_average_quantity_per_order": per_order,
        "how_much_discount_was_given": discount, "which_products_are_loss_making": part(result.products, "loss_making_products"), "which_customers_generate_the_most_revenue": customer("top_customers", 5),
        "which_products_are_declining": grown("product", "declining"), "which_products_are_growing": grown("product", "growing"), "which_category_is_declining": grown("category", "declining"), "which_category_is_growing": grown("category", "growing"),
    }
