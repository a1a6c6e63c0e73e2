from pyspark.sql import functions as F

from tallyforge.functions.numbers import num, ratio, total
from tallyforge.functions.values import is_missing, number, strip


def test_missing(spark):
    rows = [(None, None, True), ("", None, True), ("  \t", None, True), ("N/A", None, True), ("--", None, True), ("TBD", None, True), ("nicht angegeben", None, True), ("-9999", "-9999", True), ("-9999", "k.A.", False), (" k.A. ", "k.A.", True), ("Missing Parts", None, False), ("Null Modems & Cables", None, False), ("0", None, False), ("x" * 50_000, None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, t string, want boolean")
    got = df.select("i", is_missing(F.col("v"), F.col("t")).alias("m"), "want").orderBy("i").collect()
    assert [r.m for r in got] == [r.want for r in got]


def test_number(spark):
    cases = {"$4,288.63": 4288.63, "-€5.5": -5.5, "3.486e+02": 348.6, "12%": 12.0, " 7 ": 7.0, "5.": 5.0, ".5": 0.5, "₹1,337.59": 1337.59, "7f": None, "12d": None, "0x1F": None, "--5": None, "+-3": None, "1e999": None, "-Infinity": None, "nan": None, "1_000": None, "12 34": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want double")
    for r in df.select("t", number(F.col("t")).alias("n"), "want").collect():
        assert r.n == r.want, r.t
    assert spark.createDataFrame([(None,)], "t string").select(number(F.col("t"))).first()[0] is None


def test_not_a_number_is_no_missing_number(spark):
    r = spark.createDataFrame([("NaN", "nan")], "a string, b string").select(is_missing(F.col("a")).alias("text"), is_missing(F.col("a"), numeric=True).alias("number"), is_missing(F.col("b"), numeric=True).alias("small"), is_missing(F.lit("n/a"), numeric=True).alias("word")).first()
    assert (r.text, r.number, r.small, r.word) == (True, False, False, True)


def test_long_dates(spark):
    from tallyforge.functions.dates import parse_date

    long = "2024-01-31 10:00:00." + "1" * 60 + " +02:00"
    got = spark.createDataFrame([(long,), ("2024-01-31 " + "x" * 50_000,), (None,), ("",)], "t string").select(parse_date(F.col("t")).alias("d")).collect()
    assert [str(r.d) for r in got] == ["2024-01-31 10:00:00", "None", "None", "None"]


def test_strip(spark):
    odd = "\u3000\u00a0\ufeff\t a\u00a0b \u2009\u200b\r\n"
    assert spark.createDataFrame([(odd,)], "t string").select(strip(F.col("t"))).first()[0] == "a\u00a0b"
    assert spark.createDataFrame([("  a b \n",)], "t string").select(strip(F.col("t"))).first()[0] == "a b"


def test_sums_and_ratios(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.2, 0.0), (float("nan"), 0.0), (None, None)], "a double, b double")
    assert df.agg(total(num(F.col("a"), df.schema["a"].dataType)).alias("s")).first().s == 0.3
    assert df.where("b > 5").agg(total(F.col("a")).alias("s")).first().s == 0.0
    big = spark.createDataFrame([(1e30,), (1e30,)], "a double")
    assert big.agg(total(F.col("a")).alias("s")).first().s == 2e30
    got = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double").select(ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [float("inf"), float("-inf"), None, 0.5]
