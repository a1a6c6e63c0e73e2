import pytest

from tallyforge.semantics import detect_semantics, match_score, normalise_name


@pytest.mark.parametrize("name,want", [("discountedSellingPrice", "discounted_selling_price"), ("HTTPServer", "http_server"), ("Order ID", "order_id"), ("unit-price", "unit_price"), (" Total ", "total"), ("aBC", "a_bc")])
def test_names(name, want):
    assert normalise_name(name) == want


def test_scores():
    assert [match_score(n, "revenue") for n in ("revenue", "total_revenue", "salesperson", "colour")] == [100, 80, 50, 0]


def test_gates_and_ties():
    assert detect_semantics({"revenue": "categorical", "sales": "float"}) == {}
    assert detect_semantics({"order_date": "text", "d": "date"}) == {}
    assert detect_semantics({"sales": "float", "amount": "float"}) == {"revenue": "sales"}
    assert detect_semantics({"Category": "categorical", "name": "identifier", "mrp": "integer", "discountPercent": "integer", "discountedSellingPrice": "integer", "quantity": "integer"})["product"] == "name"
    assert "product" not in detect_semantics({"job_title": "categorical"})


@pytest.mark.parametrize("concept,names", [("customer", ["buyer_id", "client_id", "user_id", "cust_id", "member_id"]), ("order", ["transaction_id", "invoice_no", "receipt_no", "bill_no", "txn_id"]), ("cost", ["cogs", "cost_price", "purchase_cost", "unit_cost", "buying_price"]), ("price", ["unit_price", "mrp", "list_price"]), ("category", ["department", "segment"])])
def test_aliases(concept, names):
    for n in names:
        assert detect_semantics({n: "identifier"}) == {concept: n}
