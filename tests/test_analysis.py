import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.cli import main
from tallyforge.errors import EmptyDataset, NoCustomerIdentifier, NoTrendData
from tallyforge.operators import quality as Q
from tallyforge.operators.cleaning import clean
from tallyforge.plans.analysis import AnalysisResult, analyze, by_severity, clean_file, profile, quality_check, recommendations
from tallyforge.plans.catalog import answer_rows
from tallyforge.reporting.pdf import write_pdf
from tallyforge.reporting.terminal import render_table


def sales_rows(n=300):
    rnd = random.Random(42)
    for i in range(n):
        q, price = rnd.randrange(1, 10), round(rnd.uniform(50, 500), 2)
        yield (f"ORD-{i + 1}", str(date(2024, 1, 1) + timedelta(i)), f"CUST-{rnd.randrange(60)}", f"SKU-{rnd.randrange(20)}", rnd.choice(["Electronics", "Grocery", "<b>Home</b>"]), q, price, q * price, round(q * price * rnd.uniform(0.5, 0.95), 2), round(rnd.uniform(0, 25), 2), rnd.random() < 0.5)


HEAD = ["order_id", "order_date", "customer_id", "product_id", "category", "quantity", "unit_price", "revenue", "cost", "discount_pct", "in_stock"]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("d") / "sales.csv"
    p.write_text("\n".join([",".join(HEAD), *(",".join(map(str, r)) for r in sales_rows())]))
    return p


@pytest.fixture(scope="module")
def result(spark, path):
    return analyze(path, verbose=False, spark=spark)


def test_meaning_and_figures(result):
    assert result.semantics == {"order": "order_id", "customer": "customer_id", "product": "product_id", "category": "category", "date": "order_date", "discount": "discount_pct", "cost": "cost", "profit": "_derived_profit", "revenue": "revenue", "quantity": "quantity", "price": "unit_price"}
    rows, k = list(sales_rows()), result.kpis()
    assert k["orders"] == 300 and abs(k["total_revenue"] - sum(r[7] for r in rows)) < 0.01 and abs(k["total_profit"] - sum(r[7] - r[8] for r in rows)) < 0.01
    assert k["customers"] == len({r[2] for r in rows}) and k["products"] == 20
    t = result.trends()
    assert t["granularity"] == "monthly" and len(t["periods"]) == 10 and t["periods"][0] == "2024-01-31" and t["yoy_pct"] is None
    assert result.profile["rows"] == 300 and result.dtypes["order_id"] == "identifier" and result.dtypes["in_stock"] == "boolean" and result.dtypes["order_date"] == "date"
    assert 0 <= result.quality()["quality_score"] <= 100 and set(result.statistics()) >= {"revenue", "cost"}
    assert len(result.products()["top_products_by_revenue"]) == 10 and result.categories()["unique_categories"] == 3
    assert result.customers()["unique_customers"] == k["customers"] and result.growth()["category"]["available"]
    assert result.anomalies()["z_threshold"] == 3.0


def test_questions(result):
    every = result.ask()
    assert len(every) >= 20 and result.ask("how_many_orders") == {"available": True, "answer": 300} and not result.ask("what")["available"]


def test_outputs(result, tmp_path):
    out = result.report(tmp_path / "r")
    assert all(p.exists() for p in out.values()) and sum(k.startswith("chart_") for k in out) == 12
    html = out["dashboard"].read_text()
    assert "<b>Home</b>" not in html and "&lt;b&gt;Home" in html and html.count("<svg") >= 6
    assert out["pdf_report"].read_bytes().startswith(b"%PDF-1.4")
    assert "REVENUE BY CATEGORY" in result.table() and "Rows: 300" in result.summary()
    assert result.dashboard(tmp_path / "folder").name == "dashboard.html"


def test_loss_makers_and_categories_are_whole(spark, tmp_path):
    rows = [(f"SKU-{i}", f"cat {i}", 100.0, 100.0 + i) for i in range(1, 1201)] + [("SKU-gain", "cat gain", 100.0, 1.0)]
    r = AnalysisResult(spark.createDataFrame(rows, "product_id string, category string, revenue double, cost double"), "t")
    losing = [(x.product, x.profit) for x in r.products()["loss_making_products"].collect()]
    assert losing == [(f"SKU-{i}", -float(i)) for i in range(1200, 0, -1)] and r.products()["loss_making_product_count"] == 1200
    assert r.ask("which_products_are_loss_making")["answer"].count() == 1200 and r.ask("which_category_generates_the_highest_profit")["answer"] == {"category": "cat gain", "profit": 99.0}
    assert {k: r.categories()[k].count() for k in ("revenue_by_category", "profit_by_category", "margin_by_category")} == dict.fromkeys(("revenue_by_category", "profit_by_category", "margin_by_category"), 1201)
    got = answer_rows(spark, r.ask()).where("question = 'which_products_are_loss_making'").collect()
    assert len(got) == 1200 and {"SKU-1200", "SKU-1"} <= {json.loads(x.answer)["product"] for x in got}
    out = r.export(tmp_path / "x")
    said = json.loads(out["business_questions"].read_text())["which_products_are_loss_making"]
    assert len(said["answer"]) == 1000 and said["answer"][0]["product"] == "SKU-1200" and said["cut"] == "The first 1,000 of 1,200 rows."
    assert spark.read.parquet(str(out["loss_making_products"])).count() == 1200
    assert {c.key: c.note for c in r.visualize()}["revenue_by_category_bar"] == "The first 1,000 of 1,201 rows." and "The first 10 of 1,201 rows." in r.table()


def test_provider(spark, path):
    class P:
        def generate(self, context):
            return [{"severity": "LOW", "title": "a", "recommendation": "x"}, {"severity": "HIGH", "title": str(context["kpis"]["orders"]), "recommendation": "x"}]

    r = analyze(path, P(), verbose=False, spark=spark)
    assert [i["title"] for i in r.insights()] == ["300", "a"] and r.recommendations() == ["x"]
    assert by_severity([{"severity": "odd"}, {"severity": "MEDIUM"}])[0]["severity"] == "MEDIUM" and recommendations([{}]) == []


def test_poor_tables(spark, tmp_path):
    def of(text):
        p = tmp_path / "t.csv"
        p.write_text(text)
        return analyze(p, verbose=False, spark=spark)

    r = of("category,revenue\nA,100\nB,200\nA,50\n")
    assert r.kpis()["total_revenue"] == 350.0
    with pytest.raises(NoTrendData):
        r.trends()
    with pytest.raises(NoCustomerIdentifier):
        r.customers()
    assert len(r.visualize()) == 12 and r.table()
    with pytest.raises(EmptyDataset):
        of("a,b\n")
    r = of("category,revenue\nA,100\nA,inf\nA,-inf\nB,400\nB,50\n")
    assert r.kpis()["total_revenue"] == 550.0 and r.quality()["missing"]["total_missing"] == 1  # two rows (A, null) are equal after cleaning
    r = of("category,notes,revenue\n書籍,,1\nCafé,,2\n😀,,3\n")
    assert r.dtypes["notes"] == "unknown" and r.profile["rows"] == 3
    r = of(",".join(f"c{i}" for i in range(300)) + ",category\n" + "\n".join(",".join(str(i * j / 7) for i in range(300)) + ",A" for j in range(20)))
    assert r.profile["columns"] == 301


def test_clean_and_profile(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("order_id,order_date,category,sales\n" + "\n".join(f'{i},2024-01-{i % 28 + 1:02d}," A ","${i * 11},000"' for i in range(1, 31)) + '\n1,2024-01-02," A ","$11,000"\n')
    df = clean_file(p, spark)
    assert df.count() == 30 and dict(df.dtypes)["order_date"] == "timestamp_ntz" and df.where("order_id = 2").first().category == "A"
    assert df.where("order_id = 2").first().sales == 22000.0
    assert profile(p, spark)["quality"]["duplicates"]["duplicate_rows"] == 1 and quality_check(p, spark)["duplicates"]["duplicate_rows"] == 1


def test_clean_log(spark):
    df = spark.createDataFrame([(1, " a", float("inf")), (2, "b", 1.0), (2, "b", 1.0)], "id int, s string, v double")
    out, log = clean(df, {})
    assert out.count() == 2 and [x["step"] for x in log] == ["strip_whitespace", "infinite_to_missing", "drop_duplicates"]


def test_types_of_odd_columns(spark):
    df = spark.createDataFrame([([1], {"a": 1}, None, b"x", True), ([2], None, None, None, None)], "a array<int>, m map<string,int>, n string, y binary, f boolean")
    assert Q.detect_types(df) == {"a": "categorical", "m": "categorical", "n": "unknown", "y": "categorical", "f": "categorical"}
    assert Q.detect_types(df.limit(0))["a"] == "unknown"


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None)], "a double, b double")
    got = {(r.column_a, r.column_b): r.correlation for r in Q.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None and abs(got["a", "a"] - 1) < 1e-9 and len(got) == 4


def test_command_line(path, tmp_path, capsys, spark):
    assert main(["quality", str(path)]) == 0 and "quality_score" in capsys.readouterr().out
    assert main(["dashboard", str(path), "-o", str(tmp_path / "d.html")]) == 0 and (tmp_path / "d.html").exists()
    assert main(["clean", str(path), "-o", str(tmp_path / "c.xlsx")]) == 0 and (tmp_path / "c.xlsx").exists()
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    assert main(["analyze", str(empty)]) == 1 and "error" in capsys.readouterr().err


def test_small_renderers(tmp_path):
    assert render_table(["Name", "Value"], [["a", 1.5], ["b", None]], "T").count("\n") == 6
    write_pdf(tmp_path / "p.pdf", [f"({i}) \\ é 書" for i in range(200)])
    assert (tmp_path / "p.pdf").read_bytes().count(b"/Type/Page/") == 3


def test_wide_correlation_against_brute_force(spark):
    import numpy as np
    import pandas as pd

    x = np.random.default_rng(1).normal(1e6, 3.0, (200, 301))
    x[:, 7] = x[:, 3] * 2 + 1
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(301)])
    pdf.iloc[::7, 5] = None
    pdf["c9"] = np.nan
    got = {(r.column_a, r.column_b): r.correlation for r in Q.correlation_matrix(spark.createDataFrame(pdf).repartition(5), list(pdf.columns)).collect()}
    want = pdf.corr()
    assert len(got) == 301 * 301 and abs(got["c3", "c7"] - 1) < 1e-9 and got["c9", "c1"] is None
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-7 for a in ("c0", "c5", "c300") for b in pdf.columns if b != "c9")


def test_exact_quantiles_against_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(2)
    values = {"few": rnd.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "hot": np.r_[np.zeros(700), rnd.normal(0, 1, 300)], "many": rnd.normal(0, 100, 5_000)}
    df = spark.createDataFrame([(c, float(v)) for c, vs in values.items() for v in vs], "column_name string, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.column_name: r.q for r in Q.exact_quantiles(df, shares).collect()}
    for c, vs in values.items():
        assert got[c] == pytest.approx(np.quantile(vs, shares)), c
    assert Q.exact_quantiles(df.limit(0), shares).count() == 0


def test_pdf_wraps_long_lines(tmp_path):
    write_pdf(tmp_path / "w.pdf", ["x" * 250 + "END"])
    assert b"END" in (tmp_path / "w.pdf").read_bytes()


def test_sums_round_nothing_away(spark):
    from tallyforge.functions.numbers import total

    df = spark.range(100_000).select(F.lit(0.00004).alias("a"), F.lit(0.1).alias("b"), F.when(F.col("id") < 2, 1e25).otherwise(1.0).alias("c"))
    r = df.agg(total(F.col("a")).alias("a"), total(F.col("b")).alias("b"), total(F.col("c")).alias("c"), total(F.when(F.lit(False), F.lit(1.0))).alias("none")).first()
    assert abs(r.a - 4.0) < 1e-9 and r.b == 10_000.0 and r.c == pytest.approx(2e25) and r.none == 0.0


def test_more_than_a_thousand_categories(spark):
    df = spark.createDataFrame([(f"k{i}", f"p{i}", float(i), -1.0) for i in range(1_001)], "category string, product_id string, revenue double, profit double")
    r = AnalysisResult(df, "many")
    assert r.categories()["revenue_by_category"].count() == 1_001 and r.products()["loss_making_products"].count() == 1_001
    r.close()
