import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.load_profile import Baseline, load_profile


def accepted(name="x", **kw):
    facts = dict(table_name="t", column_name=name, null_rate=0.0, value_min=0.0, value_max=100.0, q=(25.0, 50.0, 75.0), bands=(0.25,) * 4, null_limit=0.1, stray_limit=0.05, band_limit=0.2, accepted=None)
    return Baseline(**facts | kw)


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, load_id int, x double, flag string, n double, fold string")


def test_issues_of_loads(spark):
    rnd = random.Random(1)
    rows, i = [], 0
    for load in range(6):
        for _ in range(800):
            x = rnd.uniform(0, 100)
            x = {1: None if rnd.random() < 0.3 else x, 2: x + 200 if rnd.random() < 0.2 else x, 3: 7.0 if rnd.random() < 0.6 else x, 4: x * 0.6, 5: float("inf") if rnd.random() < 0.3 else x}.get(load, x)
            rows.append((i, load, x, "maybe" if load == 5 and rnd.random() < 0.3 else "True", 1.0, "f"))
            i += 1
    base = {"x": accepted(), "flag": accepted("flag", accepted=["True", "False"], q=(None,) * 3, bands=(None,) * 4, value_min=None, value_max=None, band_limit=None)}
    got = {(r.column_name, r.load_id): r for r in load_profile(frame(spark, rows), "load_id", "row_id", base).collect()}
    assert len(got) == 12
    assert got["x", 0].issues == [] and got["x", 1].issues == ["null_rate"]
    assert got["x", 2].issues == ["range"] or set(got["x", 2].issues) == {"range", "distribution"}
    assert set(got["x", 3].issues) == {"stuck", "distribution"} and got["x", 4].issues == ["distribution"] and got["x", 5].issues == ["null_rate"]
    assert got["flag", 5].issues == ["pattern"] and got["flag", 0].issues == []
    assert got["x", 4].auc_alone > 0.6 > got["x", 0].auc_alone
    assert got["x", 3].distinct_values < 800 and got["x", 0].rows == 800 and got["x", 1].nulls > 150


def test_ablation_names_the_column(spark):
    rnd = random.Random(2)
    rows = [(i, 1, rnd.uniform(0, 50), "True", rnd.uniform(0, 100), "f") for i in range(1000)]
    got = {r.column_name: r for r in load_profile(frame(spark, rows), "load_id", "row_id", {"x": accepted(), "n": accepted("n")}).collect()}
    assert got["x"].ablation_loss > 0.2 > got["n"].ablation_loss and got["x"].issues == ["distribution"] and got["n"].issues == []


def test_null_loads_empty_tables_and_nothing_but_nulls(spark):
    base = {"x": accepted()}
    assert load_profile(frame(spark, []), "load_id", "row_id", base).count() == 0
    rows = [(1, None, None, None, None, None), (None, None, float("nan"), " ", None, None), (2, 3, 50.0, None, None, None)]
    got = {r.load_id: r for r in load_profile(frame(spark, rows), "load_id", "row_id", base).collect()}
    assert got[None].nulls == 2 and got[None].issues == ["null_rate"] and got[None].stray_share is None and got[3].rows == 1


def test_many_columns_are_judged_together(spark):
    rnd = random.Random(3)
    cols = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame([(i, 1, *[rnd.uniform(0, 100) for _ in cols]) for i in range(400)], ["row_id", "load_id", *cols])
    got = load_profile(df, "load_id", "row_id", {c: accepted(c) for c in cols}).collect()
    assert sorted(r.column_name for r in got) == cols and all(r.issues == [] for r in got)


@pytest.mark.parametrize("key", [lambda i: None, lambda i: 7, lambda i: i if i < 20 else None, lambda i: i if i < 20 else 7])
def test_keys_that_are_null_or_repeated(spark, key):
    rnd = random.Random(4)
    values = [[rnd.uniform(0, 100) * (0.6 if load == 1 else 1) for _ in range(6000)] for load in range(2)]
    rows = [(key(i), load, x, "True", 1.0, "f") for load in range(2) for i, x in enumerate(values[load])]
    got = {r.load_id: r for r in load_profile(frame(spark, rows), "load_id", "row_id", {"x": accepted()}).collect()}
    assert got[1].issues == ["distribution"] and got[0].issues == [] and got[1].auc_alone > 0.6 > got[0].auc_alone


def test_few_values_without_keys(spark):
    rows = [(None, 1, [10.0, 60.0, 90.0][i % 3], "True", 1.0, "f") for i in range(6000)]
    got = load_profile(frame(spark, rows), "load_id", "row_id", {"x": accepted()}).first()
    assert got.rows == 6000 and got.issues == ["distribution"]


def test_the_classifier_decides(spark, monkeypatch):
    from tallyforge.operators import load_profile as P

    rnd = random.Random(5)
    rows = [(i, load, rnd.uniform(0, 100) * (0.6 if load else 1), rnd.choice(["True", "False"]) if load else "True", 1.0, "f") for load in range(2) for i in range(2000)]
    base = {"x": accepted(), "flag": accepted("flag", accepted=["True", "False"], q=(None,) * 3, bands=(None,) * 4, value_min=None, value_max=None, band_limit=None)}
    got = {(r.column_name, r.load_id): r for r in load_profile(frame(spark, rows), "load_id", "row_id", base).collect()}
    r = got["x", 1]
    assert r.issues == ["distribution"] and got["x", 0].issues == []
    assert abs(r.moved_share - max(abs(r[f"band{i}_share"] - 0.25) for i in range(1, 5))) < 1e-4
    assert got["flag", 1].auc_alone > 0.6 and got["flag", 1].moved_share is None and got["flag", 1].auc_all >= got["flag", 1].auc_without
    test = P.discrimination
    monkeypatch.setattr(P, "discrimination", lambda *a: test(*a).withColumn("moved", F.lit(0.0)))
    assert all(r.issues == [] for r in load_profile(frame(spark, rows), "load_id", "row_id", base).collect())
