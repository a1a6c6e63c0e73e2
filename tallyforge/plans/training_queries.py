"""Queries p1 to p5 over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.timestamps import TimestampParser, issues
from tallyforge.functions.values import finite, is_missing, number, strip
from tallyforge.operators.imputation import fill_over_time
from tallyforge.operators.load_profile import load_profile, read_baselines
from tallyforge.operators.rejects import number_invalid, read_csv_records, whole_number_invalid
from tallyforge.operators.rolling import daily_totals, rolling_totals
from tallyforge.session import table

#: All real dates of the test tables lie in these years (TESTDATA.md).
YEARS = (2021, 2025)
RAW_FIELDS = ["order_id", "order_date", "category", "revenue", "is_active"]
RAW_TYPES = {"order_id": "BIGINT", "order_date": "TIMESTAMP", "revenue": "DOUBLE"}


def parser(spark: SparkSession, d: str) -> TimestampParser:
    return TimestampParser(spark, table(spark, d, "feeds"), YEARS)


def finance_rolling(spark: SparkSession, d: str) -> DataFrame:
    rows = parser(spark, d).parse(table(spark, d, "finance").select("entry_id", "date", "account", "revenue", "feed"), "date")
    rows = rows.select("entry_id", "account", F.col("ts.utc_day").alias("day"), F.round(finite(F.col("revenue")) * 100).cast("bigint").alias("cents"))
    return rolling_totals(daily_totals(rows, "account", "day", "cents", "entry_id"), (7, 30))


def p1_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of every account and calendar day."""
    money = lambda c: (F.col(c) / 100.0).alias(c.replace("_cents", "_revenue"))
    return finance_rolling(spark, d).select(
        F.col("entity").alias("account"), F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "entries",
        money("total_cents_7"), money("total_cents_30"), F.round(F.col("average_cents_7") / 100, 4).alias("average_revenue_7"), F.round(F.col("average_cents_30") / 100, 4).alias("average_revenue_30"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    spike = (F.col("total_cents_30") > 0) & (F.col("total_cents_7") * 30 > F.col("total_cents_30") * 21)
    return finance_rolling(spark, d).where(spike & (F.col("day") >= F.date_add("first_day", 29))).select(F.col("entity").alias("account"), F.date_format("day", "yyyy-MM-dd").alias("day_utc"))


DATED = [("finance", "date"), ("messy", "order_date"), ("customer_profile", "signup_date")]


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the three date columns, parsed in one go."""
    texts = [table(spark, d, name).select(F.lit(name).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), "feed", F.col(column).alias("text")) for name, column in DATED]
    return parser(spark, d).parse(texts[0].unionByName(texts[1]).unionByName(texts[2]), "text")


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three date columns as one UTC instant or day, or reported as not resolvable."""
    return normalised(spark, d).select(
        "table_name", "row_id", "text", F.col("ts.status").alias("status"), F.col("ts.kind").alias("kind"), F.col("ts.issue").alias("clock_issue"), "ts.day_shift",
        F.col("ts.utc_us").alias("utc_micros"), F.date_format("ts.utc_day", "yyyy-MM-dd").alias("utc_day"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d).select("table_name", "row_id", F.explode(issues("ts")).alias("issue"))


def checked_records(spark: SparkSession, d: str) -> DataFrame:
    """messy_raw with its fields as text and typed, ``reasons`` (empty for a valid record) and ``ts``, the parsed date of cells in doubt.

    Quotes, column counts and the cells that may be invalid come from the reject tables. Of these cells, the rules on missing values, amounts and dates clear
    those that are valid here but not in the strict form of their type.
    """
    rows = read_csv_records(table(spark, d, "messy_raw").select("raw_id", "load_id", "feed", "raw_line"), "raw_line", RAW_FIELDS, RAW_TYPES)
    p = parser(spark, d)
    late = ~F.substring("csv_order_date", 1, 4).between(*map(str, YEARS))
    rows = rows.withColumn("_doubtful_date", F.when(F.col("csv_order_date_doubt") | late, F.col("csv_order_date")))
    rows = p.parse(rows, "_doubtful_date")
    rows = p.with_feed(rows).drop("_zone", "_day_first", "_names")
    token = F.col("_token")
    field_reasons = F.array_compact(F.array(
        F.when(F.col("csv_order_id_doubt") & whole_number_invalid(F.col("csv_order_id"), token), "order_id"),
        F.when(F.col("_doubtful_date").isNotNull() & (F.col("ts.status") == "invalid"), "order_date"),
        F.when(F.col("csv_revenue_doubt") & number_invalid(F.col("csv_revenue"), token), "revenue"),
    ))
    return rows.withColumn("reasons", F.when(F.col("csv_reason").isNull(), field_reasons).otherwise(F.array("csv_reason")))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Every valid line as a typed row; values that are missing are null."""
    rows = checked_records(spark, d).where(F.size("reasons") == 0).drop("_token", "ts")
    p = parser(spark, d)
    rows = p.with_feed(p.parse(rows, "csv_order_date"))
    known = lambda c: F.when(~is_missing(F.col(c), F.col("_token")), strip(F.col(c)))
    order = F.coalesce("csv_order_id_value", F.regexp_replace(strip(F.col("csv_order_id")), r"\.0*$", "").try_cast("bigint"))
    return rows.select(
        F.col("raw_id").cast("bigint").alias("raw_id"), F.when(known("csv_order_id").isNotNull(), order).alias("order_id"), F.col("ts.utc_us").alias("order_utc_micros"),
        known("csv_category").alias("category"), F.when(known("csv_revenue").isNotNull(), F.coalesce("csv_revenue_value", number(F.col("csv_revenue")))).alias("revenue"), known("csv_is_active").alias("is_active"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return checked_records(spark, d).select(F.col("raw_id").cast("bigint").alias("raw_id"), F.explode("reasons").alias("reason"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    accepted = table(spark, d, "column_baseline")
    parts = [load_profile(table(spark, d, t), "load_id", "row_id", read_baselines(accepted, t)) for t in ("ecommerce", "messy")]
    return parts[0].unionByName(parts[1])


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Null rate, distinct count, range, strays, bands and discrimination of every load and column."""
    return profiles(spark, d)


def p4_base_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of the profile alone."""
    return profiles(spark, d).select("table_name", "column_name", "load_id", "rows", "nulls", "distinct_values", "min_value", "max_value", "strays", "top_count")


def p4_band_shares(spark: SparkSession, d: str) -> DataFrame:
    """Exact null, stray and band shares of the numeric columns."""
    rows = profiles(spark, d).where(F.col("table_name") == "ecommerce")
    return rows.select("table_name", "column_name", "load_id", *[F.round(c, 6).alias(c) for c in ("null_rate", "stray_share", *(f"band{i}_share" for i in range(1, 5)))])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("table_name", "column_name", "load_id", F.explode("issues").alias("issue"))


def filled(spark: SparkSession, d: str) -> DataFrame:
    p = parser(spark, d)
    cols = ["row_id", "feed", "product_id", "category", "revenue", "received_at"]
    rows = p.with_feed(table(spark, d, "messy").select(*cols))
    token = F.col("_token")
    rows = rows.withColumn("_product", strip(F.col("product_id")))
    no_category, amount = is_missing(F.col("category"), token), F.when(~is_missing(F.col("revenue"), token), number(F.col("revenue")))
    return fill_over_time(
        rows, "_product", "received_at", "row_id", numeric={"revenue": amount}, categorical={"category": F.when(~no_category, strip(F.col("category")))},
        missing={"revenue": amount.isNull(), "category": no_category},
    )


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """All rows of messy with category and revenue filled, and how."""
    return filled(spark, d).select(
        F.col("row_id").cast("bigint").alias("row_id"), "product_id", "category_value", "category_filled", "category_method", F.round("category_distance", 3).alias("category_distance"),
        F.round("revenue_value", 4).alias("revenue_value"), "revenue_filled", "revenue_method", F.round("revenue_distance", 3).alias("revenue_distance"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array_compact(F.array(F.when(F.col("category_filled"), "category"), F.when(F.col("revenue_filled"), "revenue")))
    return filled(spark, d).select(F.col("row_id").cast("bigint").alias("row_id"), F.explode(cells).alias("column_name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_rolling_totals": p1_rolling_totals, "p2_found": p2_found, "p2_normalised": p2_normalised, "p3_found": p3_found, "p3_loaded": p3_loaded,
    "p4_found": p4_found, "p4_profile": p4_profile, "p4_base_aggregates": p4_base_aggregates, "p4_band_shares": p4_band_shares, "p5_found": p5_found, "p5_filled": p5_filled,
}
