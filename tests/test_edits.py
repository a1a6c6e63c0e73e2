from datetime import datetime

import pytest

from tallyforge.errors import DeleteMatchedNothing, DestructiveStatement, NoBackup, UpdateMatchedNothing
from tallyforge.operators.dataset import KEEP, DataAsset, matches
from tallyforge.operators.lazy import LargeDataAsset, as_of_join
from tallyforge.streaming.windows import sessions, windowed_totals


@pytest.fixture
def asset(spark):
    return DataAsset(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, s string"), "x.csv")


def got(a):
    return sorted((tuple(r) for r in a.df.collect()), key=str)


def test_edits_and_log(asset, tmp_path):
    e = asset.update({"id": 1}, {"s": "z", "new": 5})
    assert e["rows_affected"] == 1 and e["before"] == [{"s": "a"}] and e["after"] == [{"s": "z", "new": 5}] and asset.df.columns == ["id", "s", "new"]
    asset.insert({"id": 9, "extra": "e"})
    assert len(asset) == 4 and asset.delete({"s": "c"})["removed_sample"][0]["s"] == "c"
    assert asset.upsert({"id": 2, "s": "bb"}, "id")["operation"] == "update" and asset.upsert({"id": 7}, "id")["operation"] == "upsert_insert"
    assert (2, "bb", None, None) in got(asset)
    for _ in range(5):
        asset.rollback()
    assert got(asset) == [(1, "a"), (2, "b"), (None, "c")]
    with pytest.raises(NoBackup):
        asset.rollback()
    assert asset.save_audit_log(tmp_path / "l" / "log.json").read_text().count("timestamp") == 10


def test_refused_edits_change_nothing(asset):
    with pytest.raises(UpdateMatchedNothing):
        asset.update({"no": 1}, {"s": "x"})
    with pytest.raises(DeleteMatchedNothing):
        asset.delete({"id": None})
    with pytest.raises(ValueError):
        asset.upsert({"s": "x"}, "id")
    assert not asset.audit_log and not asset._states


def test_snapshots_are_bounded_and_plans_cut(asset):
    for i in range(30):
        asset.insert({"id": 100 + i})
    assert len(asset._states) == KEEP and len(asset) == 33


def test_merge_matches_nulls(spark, asset):
    other = spark.createDataFrame([(1, "o1"), (None, "o2"), (5, "o5")], "id int, s string")
    e = asset.merge(other, "id", "outer")
    assert set(e["new_columns"]) == {"s_x", "s_y"} and got(asset) == [(1, "a", "o1"), (2, "b", None), (5, None, "o5"), (None, "c", "o2")]
    with pytest.raises(ValueError):
        asset.merge(other, "id", "cross")


def test_lazy(spark, tmp_path):
    (tmp_path / "a.csv").write_text("category,revenue\nA,1\nB,2\nA,3\n")
    t = LargeDataAsset(tmp_path / "a.csv", spark)
    assert t.count() == 3 and t.columns() == ["category", "revenue"]
    assert [tuple(r) for r in t.aggregate("category", "sum(revenue) AS s", where="revenue > 0", order_by="s DESC", limit=1).collect()] == [("A", 4)]
    assert t.aggregate("category", limit=0).count() == 2
    assert t.query("SELECT * EXCLUDE (revenue) FROM data").columns == ["category"] and len(t.to_pandas(2)) == 2 and t.sample(1).count() == 1
    assert t.query("WITH x AS (SELECT 1 AS k) SELECT * FROM x").first().k == 1
    for bad in ("DROP VIEW data", "DELETE FROM data", "INSERT INTO data VALUES (1)", "CREATE TABLE q AS SELECT 1", "TRUNCATE TABLE data", "/* hi */ DROP TABLE data", "SET x=1"):
        with pytest.raises(DestructiveStatement):
            t.query(bad)
    with pytest.raises(Exception):
        t.query("SELECT 1; DROP TABLE data")
    with pytest.raises(ValueError):
        LargeDataAsset(tmp_path / "a.abc", spark)
    t.close()


def test_as_of(spark):
    at = lambda h: datetime(2023, 1, 1 + h // 24, h % 24)
    left = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(50)), (3, "b", at(5)), (4, None, at(5)), (5, "a", None)], "i int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(2), 1.0), ("a", at(49), 2.0), ("a", at(50), 3.0), ("b", at(6), 9.0)], "k string, t timestamp, v double")
    assert [tuple(r) for r in as_of_join(left, right, "t", ["k"], ["v"]).select("i", "v").orderBy("i").collect()] == [(1, None), (2, 3.0), (3, None), (4, None), (5, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2023, 1, 1 + i % 3, i % 24), "a" if i % 2 else "b", float(i)) for i in range(60)] + [(99, None, "a", 1.0)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_totals(stream, "ts", ["kind"], "v", late="1 day").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM totals").collect())) == sorted(map(tuple, windowed_totals(df, "ts", ["kind"], "v").collect()))
    assert sessions(df, "ts", "kind", "2 hours").agg({"events": "sum"}).first()[0] == 60


def test_values_of_another_kind_match_nothing(spark):
    df = spark.createDataFrame([(1, "a", True, datetime(2024, 1, 1)), (2, "b", None, None)], "id int, s string, ok boolean, at timestamp")
    n = lambda w: df.where(matches(df, w)).count()
    assert n({"s": 5}) == n({"id": "abc"}) == n({"id": None}) == n({"id": float("nan")}) == n({"id": 2**70}) == n({"id": [1]}) == 0
    assert n({"id": 1.0}) == n({"id": True}) == n({"ok": 1}) == n({"at": "2024-01-01"}) == n({"at": datetime(2024, 1, 1)}) == 1
    assert n({"at": "no time"}) == 0
    a = DataAsset(df)
    with pytest.raises(UpdateMatchedNothing):
        a.update({"id": "abc"}, {"s": "x"})
    e = a.update({"id": 1}, {"id": "one", "new": 2})
    assert e["before"] == [{"id": 1}] and e["after"] == [{"id": "one", "new": 2}] and {r.id for r in a.df.collect()} == {"one", "2"}
    assert a.merge(spark.createDataFrame([("one", 1)], "id string, z int"), "id", "full")["rows_after"] == 2


@pytest.mark.parametrize("bad", [
    "SELECT * FROM (SELECT TRANSFORM(s) USING 'echo x' AS (x) FROM data)", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM data", "SELECT * FROM text.`/etc/hostname`",
    "SELECT (SELECT max(java_method('a', 'b')) FROM data) FROM data", "SELECT * FROM data WHERE s IN (SELECT value FROM text.`/etc/hostname`)", "WITH x AS (SELECT * FROM other) SELECT * FROM x",
])
def test_guard_looks_into_every_part(spark, bad):
    t = LargeDataAsset(spark.createDataFrame([("a", 1)], "s string, n int"))
    with pytest.raises(DestructiveStatement):
        t.query(bad)
    t.close()


def test_dialect_leaves_literals_alone(spark):
    t = LargeDataAsset(spark.createDataFrame([("a", 1)], "s string, n int"))
    assert t.query("SELECT 'x * EXCLUDE y' AS v FROM data -- quantile_cont(").first().v == "x * EXCLUDE y"
    r = t.query("""SELECT strftime(TIMESTAMP '2024-05-06 07:08:09', '%Y-%m-%d at %H') AS "t", date_diff('day', DATE '2024-01-01', DATE '2024-01-05') AS d, CAST(n AS TEXT) AS x FROM data""").first()
    assert (r.t, r.d, r.x) == ("2024-05-06 at 07", 4, "1")
    t.close()
