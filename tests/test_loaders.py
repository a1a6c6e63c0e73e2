import json
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.errors import DestructiveStatement, UnsupportedFileType
from tallyforge.operators.quality import ROW_ID
from tallyforge.sources.loaders import check_script, load, split_script, unique_names
from tallyforge.sources.writers import plain, save_json, write_table, write_with_fallback


def rows(df):
    return [tuple(r) for r in df.orderBy(ROW_ID).drop(ROW_ID).collect()]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return path


def test_csv_types_and_nulls(spark, tmp_path):
    df, meta = load(write(tmp_path / "a.csv", "a,b,c,d,e\n1,1.5,x,True,2024-01-01\n2,NA,,False,\n3,inf,null,true,N/A\n"), spark)
    assert meta["encoding"] == "utf-8" and dict(df.dtypes)["a"] == "bigint" and dict(df.dtypes)["b"] == "double" and dict(df.dtypes)["d"] == "boolean"
    assert rows(df)[1] == (2, None, None, False, None) and rows(df)[2][1] == float("inf")


def test_csv_ragged_duplicate_headers_and_encodings(spark, tmp_path):
    df, meta = load(write(tmp_path / "r.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n"), spark)
    assert rows(df) == [(1, 2, 3), (4, 5, None)] and "skipped 1" in meta["encoding"]
    df, _ = load(write(tmp_path / "d.csv", "revenue,revenue,category\n1,2,x\n"), spark)
    assert df.drop(ROW_ID).columns == ["revenue", "revenue.1", "category"] and unique_names(["a", "a", "", "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]
    df, meta = load(write(tmp_path / "w.csv", "id,notes\n1,it’s\n2,ok\n3,“q”\n", "cp1252"), spark)
    assert meta["encoding"] == "cp1252" and rows(df)[0][1] == "it’s"
    df, meta = load(write(tmp_path / "bom.csv", "a,b\n1,書籍\n", "utf-8-sig"), spark)
    assert meta["encoding"] == "utf-8-sig" and rows(df) == [(1, "書籍")] and df.columns[0] == "a"
    df, _ = load(write(tmp_path / "q.csv", 'a,b\n1,"two\nlines, ""q"""\n'), spark)
    assert rows(df) == [(1, 'two\nlines, "q"')]
    assert load(write(tmp_path / "h.csv", "a,b\n"), spark)[0].count() == 0


def test_json_parquet(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": 1, "created_at": "2024-01-01T10:00:00", "x": [1, 2]}, {"id": 2, "created_at": None, "x": None}]))
    df, _ = load(p, spark)
    assert dict(df.dtypes)["created_at"] == "timestamp_ntz" and df.where("id = 1").first().x == "[1,2]"
    spark.createDataFrame([(1, float("nan")), (2, 5.0)], "id int, v double").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    df, _ = load(tmp_path / "p.parquet", spark)
    assert sorted(rows(df)) == [(1, None), (2, 5.0)]


def test_databases(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as con:
        con.execute("CREATE TABLE small (a)")
        con.execute("CREATE TABLE sales (id INTEGER, x REAL, s TEXT)")
        con.executemany("INSERT INTO sales VALUES (?, ?, ?)", [(1, 1.5, "a"), (2, None, None), (3, 2.0, "c")])
    df, meta = load(tmp_path / "s.db", spark)
    assert meta["table"] == "sales" and sorted(rows(df)) == [(1, 1.5, "a"), (2, None, None), (3, 2.0, "c")]
    with duckdb.connect(str(tmp_path / "d.duckdb")) as con:
        con.execute("CREATE TABLE sales AS SELECT range AS id, range * 0.5 AS x, 'v' || range AS s, DATE '2024-01-01' AS day FROM range(5)")
    df, meta = load(tmp_path / "d.duckdb", spark)
    assert meta["table"] == "sales" and df.count() == 5 and df.agg(F.sum("x")).first()[0] == 5.0


def test_sql_scripts(spark, tmp_path):
    p = write(tmp_path / "q.sql", "-- a comment; here\nCREATE TABLE t (a INTEGER, b TEXT);\nINSERT INTO t VALUES (1, 'x;y'), (2, NULL);\nSELECT a FROM t;\nSELECT a, b FROM t ORDER BY a;")
    df, _ = load(p, spark)
    assert rows(df) == [(1, "x;y"), (2, None)]
    assert split_script("a ';' b; /* ; */ c") == ["a ';' b", "c"]
    for bad in ("DROP TABLE t; SELECT 1;", "SELECT 1; delete from t", "/* x */ ALTER TABLE t ADD c INT"):
        with pytest.raises(DestructiveStatement):
            check_script(bad)
    with pytest.raises(ValueError):
        load(write(tmp_path / "n.sql", "CREATE TABLE t (a INT);"), spark)


def test_refusals(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "none.csv", spark)
    with pytest.raises(UnsupportedFileType):
        load(write(tmp_path / "x.abc", ""), spark)


@pytest.mark.parametrize("suffix", [".csv", ".json", ".parquet", ".xlsx"])
def test_round_trips(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, 1.5, 'a "q", b', True), (2, None, None, False), (3, -2.25, "書籍 <&>", None)], "id bigint, x double, s string, b boolean")
    target = write_table(df, tmp_path / f"out{suffix}")
    back, _ = load(target, spark)
    got = sorted(tuple(r) for r in back.select("id", "x", "s", F.col("b").cast("string")).collect())
    assert [(i, x, s) for i, x, s, _ in got] == [(1, 1.5, 'a "q", b'), (2, None, None), (3, -2.25, "書籍 <&>")]
    again = write_table(back.drop(ROW_ID).where("id > 1"), target)  # over the file it is read from
    assert load(again, spark)[0].count() == 2


def test_other_suffix_returns_what_it_wrote(spark, tmp_path):
    p = write_table(spark.range(2), tmp_path / "a.txt")
    assert p.name == "a.csv" and p.exists()
    assert write_table(spark.range(5), tmp_path / "f.parquet", single_file=False).is_dir()


def test_locked_files(tmp_path):
    calls = []

    def locked(times, only=None):
        def w(p):
            calls.append(p)
            if (only is None or p.name == only) and len(calls) <= times:
                raise PermissionError
            p.write_text("x")

        return w

    assert write_with_fallback(tmp_path / "a.txt", locked(2), retry_delay=0).name == "a.txt"
    calls.clear()
    with pytest.warns(RuntimeWarning):
        p = write_with_fallback(tmp_path / "b.txt", locked(99, "b.txt"), retry_delay=0)
    assert p.name.startswith("b_") and p.exists()
    calls.clear()
    with pytest.raises(PermissionError):
        write_with_fallback(tmp_path / "c.txt", locked(99), retry_delay=0)


def test_json_values(tmp_path):
    assert json.loads(save_json(tmp_path / "a.json", {"n": 3, "x": float("nan"), "l": [1.5, None]}).read_text()) == {"n": 3, "x": None, "l": [1.5, None]}
    assert plain({1: (float("inf"),)}) == {"1": [None]}
