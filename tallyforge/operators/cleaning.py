"""Conservative cleaning as one chained plan, with a log of what changed.

Order: strip white space of texts, parse the date column, read texts that stand for numbers, infinities to null, equal rows once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from tallyforge.functions.dates import parse_date
from tallyforge.functions.values import number, strip
from tallyforge.operators.quality import ROW_ID, data_columns

NUMERIC = ("revenue", "cost", "profit", "quantity", "discount", "price")


def strip_text(df: DataFrame) -> DataFrame:
    return df.select(*[strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def drop_infinite(df: DataFrame) -> DataFrame:
    def fix(f):
        c = F.col(f"`{f.name}`")
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else c

    return df.select(*[fix(f) for f in df.schema.fields])


def dedupe(df: DataFrame) -> DataFrame:
    """Each set of equal rows once (nulls equal); with a row id, the smallest is kept."""
    keys = [f"`{c}`" for c in data_columns(df)]
    if ROW_ID in df.columns:
        return df.groupBy(*keys).agg(F.min(ROW_ID).alias(ROW_ID)).select(*[f"`{c}`" for c in df.columns])
    return df.dropDuplicates()


def clean(df: DataFrame, semantics: dict[str, str], keep: StorageLevel | None = None) -> tuple[DataFrame, list[dict]]:
    """Cleaned table and log. The log's counts are two aggregate jobs; a text column is read as numbers only if at least one value is one. With ``keep`` the table is persisted before it is counted."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    date = semantics.get("date")
    coerce = [semantics[c] for c in NUMERIC if semantics.get(c) in texts]
    q = lambda c: F.col(f"`{c}`")
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(strip(q(c)) != q(c)).alias(f"s{i}") for i, c in enumerate(texts)]
    counts += [F.count(number(q(c))).alias(f"n{i}") for i, c in enumerate(coerce)]
    counts += [F.count_if(F.abs(q(c)) == F.lit(float("inf"))).alias(f"i{i}") for i, c in enumerate(floats)]
    if date in df.columns:
        counts.append(F.count_if(q(date).isNotNull() & parse_date(q(date), df.schema[date].dataType).isNull()).alias("bad_dates"))
    r = df.agg(*counts).first().asDict()
    log = []
    stripped = [c for i, c in enumerate(texts) if r[f"s{i}"]]
    if stripped:
        log.append({"step": "strip_whitespace", "columns": stripped})
    out = strip_text(df)
    if date in df.columns and isinstance(df.schema[date].dataType, StringType):
        out = out.withColumn(date, parse_date(q(date), out.schema[date].dataType))
        log.append({"step": "parse_dates", "column": date, "invalid": r["bad_dates"]})
    for i, c in enumerate(coerce):
        if r[f"n{i}"]:
            out = out.withColumn(c, number(q(c)))
            log.append({"step": "read_numbers", "column": c, "numbers": r[f"n{i}"]})
    for i, c in enumerate(floats):
        if r[f"i{i}"]:
            log.append({"step": "infinite_to_missing", "column": c, "values": r[f"i{i}"]})
    out = dedupe(drop_infinite(out))
    out = out.persist(keep) if keep else out
    dropped = r["rows"] - out.count()
    if dropped:
        log.append({"step": "drop_duplicates", "rows": dropped})
    return out, log
