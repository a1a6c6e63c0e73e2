"""Every query with SQL gives the rows of its SQL; every other one runs."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.plans import catalog

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    with duckdb.connect() as c:
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        yield c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).count()


def test_questions_over_sales_are_all_answered(spark, con, sf_dir):
    rows = QUERIES["question_answers"](spark, sf_dir).collect()
    assert len({r.question for r in rows}) == 23 and all(r.available for r in rows)
    said = {r.question: r.answer for r in rows}
    losing = {x["product"]: x["profit"] for r in rows if r.question == "which_products_are_loss_making" for x in [json.loads(r.answer)]}
    want = dict(con.execute(SQL["product_loss_making"]).fetchall())
    assert losing.keys() == want.keys() and all(abs(losing[k] - float(v)) < 0.01 for k, v in want.items())
    orders, customers, products = con.execute("SELECT COUNT(DISTINCT l_orderkey), COUNT(DISTINCT o_custkey), COUNT(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchone()
    assert (said["how_many_orders"], said["how_many_unique_customers"], said["how_many_products_sold"]) == (str(orders), str(customers), str(products))


def test_quality_score_counts_invalid_dates(spark, sf_dir, monkeypatch):
    whole = catalog.orders_as_delivered
    clean = QUERIES["quality_score"](spark, sf_dir).first()[0]
    monkeypatch.setattr(catalog, "orders_as_delivered", lambda s, d: whole(s, d).withColumn("order_date", F.concat(F.lit("no date "), F.col("order_date").cast("string"))))
    assert QUERIES["quality_score"](spark, sf_dir).first()[0] < clean


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
