"""Type labels, data-quality reports, score, outliers, anomalies and descriptive statistics.

Every report over all columns is one aggregate job. Columns that hold arrays, maps or structs are read as JSON text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

from tallyforge.functions.dates import parse_date
from tallyforge.functions.numbers import col_num
from tallyforge.semantics import KEYWORDS, normalise_name

ROW_ID = "_row_id"
INTEGERS = (ByteType, ShortType, IntegerType, LongType)
FLOATS = (FloatType, DoubleType, DecimalType)
NUMERIC_LABELS = ("integer", "float")
#: Relative error of a distinct estimate that counts as possible (several standard errors of a sketch of 2 ** SKETCH registers); nearer to a threshold columns are counted exactly.
SKETCH, SKETCH_ERROR = 12, 0.08
#: Accuracy (1 / relative rank error) of the estimates around which exact quantiles are looked for.
ACCURACY = 10_000
DATE_RATIO, DATE_HINT_RATIO = 0.85, 0.5


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def flatten(df: DataFrame) -> DataFrame:
    """Arrays, maps, structs and binaries as text; NaN as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, BinaryType):
            c = F.base64(c)
        elif isinstance(f.dataType, (FloatType, DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_row_id(df: DataFrame) -> DataFrame:
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def cell_counts(df: DataFrame) -> DataFrame:
    """(column_name, filled, distinct_values, mean_length, rows): one row per column.

    Cells are turned into (column, value) pairs and counted in two steps, so 300 columns need two shuffles, not 300 expansions.
    """
    cols = data_columns(df)
    cells = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])
    per_value = df.select(F.explode(cells).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("v").isNotNull()
    return per_value.groupBy(F.col("k").alias("column_name")).agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("filled"), F.count("v").alias("distinct_values"),
        F.try_divide(F.sum(F.length("v") * F.col("n")), F.sum(F.when(there, F.col("n")))).alias("mean_length"), F.sum("n").alias("rows"),
    )


def sketched(df: DataFrame) -> dict:
    """Facts of every column from one pass without a shuffle of cells: filled, estimated distinct values, mean length and, for texts, the share that parses as dates."""
    cols = data_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        v, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
        aggs += [F.count(v).alias(f"n{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(text, F.lit(SKETCH))).alias(f"d{i}"), F.avg(F.length(text)).alias(f"l{i}")]
        if isinstance(df.schema[c].dataType, StringType):
            aggs.append(F.count(parse_date(v)).alias(f"t{i}"))
    r = df.agg(*aggs).first().asDict()
    return {c: {"rows": r["rows"], "filled": r[f"n{i}"], "distinct": r[f"d{i}"] or 0, "mean_length": r[f"l{i}"], "dates": r.get(f"t{i}", 0)} for i, c in enumerate(cols)}


def detect_types(df: DataFrame) -> dict[str, str]:
    """Column -> unknown, boolean, datetime, date, identifier, integer, float, categorical or text.

    Distinct values are estimated in one pass over all rows; only columns whose estimate lies near a threshold of the rules are counted exactly. A text column is
    one of dates by the share of all its values that parse.
    """
    df = flatten(df)
    cols = data_columns(df)
    stats = sketched(df) if cols else {}

    def near(c: str) -> bool:
        s, t = stats[c], df.schema[c].dataType
        if not s["filled"] or isinstance(t, (BooleanType, TimestampType, TimestampNTZType, DateType, *FLOATS)):
            return False
        close = lambda limit: abs(s["distinct"] - limit) <= SKETCH_ERROR * limit + 2
        return close(20) or any(close(x * s["rows"]) for x in (0.5, 0.9, 0.95))

    exact = [c for c in cols if near(c)]
    if exact:
        for r in cell_counts(df.select(*[F.col(f"`{c}`") for c in exact])).collect():
            stats[r.column_name]["distinct"] = r.distinct_values
    labels = {}
    for c in cols:
        t, s = df.schema[c].dataType, stats[c]
        distinct, n = s["distinct"], s["rows"]
        if not s["filled"]:
            labels[c] = "unknown"
            continue
        full = s["filled"] == n
        if isinstance(t, BooleanType) and full:
            labels[c] = "boolean"
        elif isinstance(t, (TimestampType, TimestampNTZType)):
            labels[c] = "datetime"
        elif isinstance(t, DateType):
            labels[c] = "date"
        elif isinstance(t, INTEGERS) and full:
            labels[c] = "identifier" if distinct / n > 0.95 and distinct > 20 else "integer"
        elif isinstance(t, INTEGERS + FLOATS):
            labels[c] = "float"
        else:
            dates = s["dates"] / s["filled"]
            hint = any(h in normalise_name(c) for h in KEYWORDS["date"])
            if dates >= DATE_RATIO or hint and dates >= DATE_HINT_RATIO:
                labels[c] = "date"
            elif distinct / n > 0.9 and distinct > 20:
                labels[c] = "identifier"
            elif distinct / n < 0.5 or (s["mean_length"] or 0) < 30:
                labels[c] = "categorical"
            else:
                labels[c] = "text"
    return labels


def numeric_columns(labels: dict[str, str]) -> list[str]:
    return [c for c, t in labels.items() if t in NUMERIC_LABELS]


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing) for every column, from one pass."""
    cols = data_columns(df)
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)])
    return one.select(F.inline(pairs))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows): rows after the first of each equal set; nulls are equal."""
    groups = df.groupBy(*[f"`{c}`" for c in data_columns(df)]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """(duplicate_ids): rows after the first of each id; repeated nulls count."""
    groups = df.groupBy(F.col(f"`{column}`").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_ids"))


def numeric_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, v) of every number of the columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), col_num(df, c).alias("v")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("v").isNotNull())


def exact_quantiles(cells: DataFrame, shares: list[float]) -> DataFrame:
    """(column_name, q): exact quantiles, linear between neighbours, of (column_name, v); one row per column with values.

    Estimates a little below and above every share cut the values of a column into ranges. The counts of the ranges, one row each, tell which of them hold the wanted
    ranks; only their values, a small part of all (equal ones counted once), are shuffled and put in order. An estimate that is off makes a range larger, never the result wrong.
    """
    edges = sorted({min(1.0, max(0.0, x + d)) for x in shares for d in (-2 / ACCURACY, 2 / ACCURACY)})
    cuts = cells.groupBy("column_name").agg(F.percentile_approx("v", edges, ACCURACY).alias("cuts"))  # one row per column: as many as the schema has
    place_of = reduce(lambda a, b: a + b, [(F.get("cuts", F.lit(i)) < F.col("v")).cast("int") for i in range(len(edges))])
    placed = cells.join(F.broadcast(cuts), "column_name").select("column_name", "v", place_of.alias("range"))
    ranges = Window.partitionBy("column_name").orderBy("range")
    whole = Window.partitionBy("column_name")
    sums = placed.groupBy("column_name", "range").agg(F.count(F.lit(1)).alias("n")).select("column_name", "range", "n", (F.sum("n").over(ranges) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    place = lambda x: (F.col("total") - 1) * F.lit(float(x))
    ranks = F.array_distinct(F.array(*[f(place(x)).cast("bigint") for x in shares for f in (F.floor, F.ceil)]))
    wanted = sums.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).where(F.size("ranks") > 0).drop("n")
    # at most two ranks per share and column
    held = placed.join(F.broadcast(wanted), ["column_name", "range"]).groupBy("column_name", "range", "before", "total", "ranks", "v").agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("column_name", "range").orderBy("v")))
    hits = held.select("column_name", "total", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    at = hits.groupBy("column_name", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def value(x: float):
        low, high = F.floor(place(x)), F.ceil(place(x))
        a, b = F.element_at("at", low.cast("bigint")), F.element_at("at", high.cast("bigint"))
        return F.when(low == high, a).when(a == b, a).otherwise((high - place(x)) * a + (place(x) - low) * b)

    return at.select("column_name", F.array(*[value(x) for x in shares]).alias("q"))


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, q1, q3), linear, exact; one row per column with values."""
    return exact_quantiles(numeric_cells(df, columns), [0.25, 0.75]).select("column_name", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, outliers): values beyond 1.5 interquartile ranges; columns without spread are skipped."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string, outliers bigint")
    bounds = quartiles(df, columns).where(F.col("q3") > F.col("q1"))  # one row per column: as many as the schema has
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    hit = (F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)
    return numeric_cells(df, columns).join(F.broadcast(bounds), "column_name").groupBy("column_name").agg(F.count_if(hit).alias("outliers"))


def negative_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, negatives)"""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(col_num(df, c) < 0).alias("negatives")) for c in columns])
    return df.agg(cells.alias("x")).select(F.inline("x"))


def invalid_dates(df: DataFrame, column: str) -> DataFrame:
    """(invalid_dates): values that are there and don't parse."""
    c = F.col(f"`{column}`")
    return df.agg(F.count_if(c.isNotNull() & parse_date(c, df.schema[column].dataType).isNull()).alias("invalid_dates"))


def quality(df: DataFrame, semantics: dict[str, str], labels: dict[str, str], distinct: bool = False) -> dict:
    """All reports and the score from 0 to 100. ``distinct`` says that no two rows are equal (as after cleaning), which spares the search."""
    cols = data_columns(df)
    if distinct:
        n, duplicates = df.count(), 0
    else:
        dup = duplicate_rows(df).first()
        n, duplicates = dup.rows, dup.duplicate_rows
    missing = {r.column_name: r.missing for r in missing_counts(df).collect()} if cols else {}
    numeric = numeric_columns(labels)
    outliers = {r.column_name: r.outliers for r in iqr_outliers(df, numeric).collect() if r.outliers}
    measured = [semantics[k] for k in ("revenue", "cost", "quantity") if semantics.get(k) in numeric]
    negatives = {r.column_name: r.negatives for r in negative_values(df, measured).collect() if r.negatives} if measured else {}
    date, order = semantics.get("date"), semantics.get("order")
    bad_dates = invalid_dates(df, date).first()[0] if date in cols else None
    repeated = duplicate_ids(df, order).first()[0] if order in cols else None
    share = lambda k: 100 * k / max(n, 1)
    missing_pct = round(100 * sum(missing.values()) / max(n * len(cols), 1), 2)
    duplicate_pct = round(share(duplicates), 2)
    losses = [
        min(0.6 * missing_pct, 30), min(0.8 * duplicate_pct, 20), min(0.2 * share(sum(outliers.values())), 15), min(5 * len(negatives), 15),
        min(0.3 * share(bad_dates or 0), 10), min(0.3 * share(repeated or 0), 10),
    ]
    return {
        "quality_score": max(0.0, min(100.0, round(100 - sum(losses), 1))),
        "missing": {"total_missing": sum(missing.values()), "missing_pct": missing_pct, "by_column": {c: k for c, k in missing.items() if k}},
        "duplicates": {"duplicate_rows": duplicates, "duplicate_pct": duplicate_pct},
        "outliers": {"total_outliers": sum(outliers.values()), "by_column": outliers},
        "negative_values": negatives,
        "invalid_dates": {"column": date, "invalid_dates": bad_dates} if bad_dates else {},
        "duplicate_ids": {"column": order, "duplicate_ids": repeated} if repeated else {},
        "rows": n,
    }


def full_profile(df: DataFrame, semantics: dict[str, str], labels: dict[str, str] | None = None, distinct: bool = False) -> dict:
    labels = labels or detect_types(df)
    q = quality(df, semantics, labels, distinct)
    of = lambda *kinds: [c for c, t in labels.items() if t in kinds]
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a remote session has no plan at hand
        size = 0
    return {
        "rows": q["rows"], "columns": len(data_columns(df)), "memory_bytes": size, "dtypes": labels, "numeric_columns": of(*NUMERIC_LABELS), "categorical_columns": of("categorical"),
        "date_columns": of("date", "datetime"), "boolean_columns": of("boolean"), "text_columns": of("text"), "identifier_columns": of("identifier"), "quality": q,
    }


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean, std): one global row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.avg(col_num(df, c)).alias("mean"), F.stddev_samp(col_num(df, c)).alias("std")) for c in columns])
    return df.agg(cells.alias("x")).select(F.inline("x"))


def zscore_flags(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Rows of ``df`` with one boolean ``z_<column>`` each: further than ``threshold`` standard deviations from the mean.

    Means and deviations are one row per column and go into the plan as literals.
    """
    facts = {r.column_name: r for r in moments(df, columns).collect()} if columns else {}
    flags = []
    for c in columns:
        m, s = facts[c].mean, facts[c].std
        hit = F.abs(col_num(df, c) - F.lit(m)) / F.lit(s) > threshold if s else F.lit(False)
        flags.append(F.coalesce(hit, F.lit(False)).alias(f"z_{c}"))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in {f"z_{x}" for x in columns}], *flags)


def anomalies(df: DataFrame, columns: list[str], threshold: float = 3.0, first: int = 50) -> dict:
    if not columns:
        return {"z_threshold": threshold, "total_anomalies": 0, "by_column": {}, "row_indices": []}
    flags = zscore_flags(with_row_id(df), columns, threshold)
    any_hit = reduce(lambda a, b: a | b, [F.col(f"`z_{c}`") for c in columns])
    r = flags.agg(*[F.count_if(F.col(f"`z_{c}`")).alias(f"n{i}") for i, c in enumerate(columns)], F.count_if(any_hit).alias("rows")).first()
    rows = [x[0] for x in flags.where(any_hit).select(ROW_ID).orderBy(ROW_ID).limit(first).collect()]
    return {"z_threshold": threshold, "total_anomalies": r["rows"], "by_column": {c: r[f"n{i}"] for i, c in enumerate(columns) if r[f"n{i}"]}, "row_indices": rows}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean, median, std, min, max, q1, q3) per numeric column, exact; std of one value is 0."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, mean double, median double, std double, min double, max double, q1 double, q3 double")
    facts = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).alias(f"x{i}") for i, c in enumerate(columns) for v in [col_num(df, c)]])
    facts = facts.select(F.inline(F.array(*[f"x{i}" for i in range(len(columns))])))
    q = exact_quantiles(numeric_cells(df, columns), [0.25, 0.5, 0.75])
    # one row per column on both sides
    return facts.join(F.broadcast(q), "column_name", "left").select("column_name", "mean", F.col("q")[1].alias("median"), "std", "min", "max", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"))


def _moments(x: np.ndarray) -> np.ndarray:
    """Pairwise counts, means, squares and products about the means of a block of rows (NaN: missing), stacked; [i, j] is over rows where both are there."""
    there = ~np.isnan(x)
    shift = np.where(there.any(0), np.nansum(x, 0) / np.maximum(there.sum(0), 1), 0.0)
    m, v = there.astype(float), np.where(there, x - shift, 0.0)
    n, s = m.T @ m, v.T @ m
    k = np.maximum(n, 1)
    return np.stack([n, s / k + shift[:, None], (v * v).T @ m - s * s / k, v.T @ v - s * s.T / k])


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    d, w = b[1] - a[1], a[0] * b[0] / np.maximum(n, 1)
    mean = np.where(n > 0, (a[0] * a[1] + b[0] * b[1]) / np.maximum(n, 1), 0.0)
    return np.stack([n, mean, a[2] + b[2] + d * d * w, a[3] + b[3] + d * d.T * w])


def correlation_matrix(df: DataFrame, columns: list[str], groups: int = 64) -> DataFrame:
    """(column_a, column_b, correlation) for every ordered pair: Pearson over rows where both are there; null without spread. One pass for any number of columns.

    Every partition adds its rows up to one set of pairwise moments (matrix products in Arrow batches); these are added by groups of partitions, then once more.
    """
    spark, k = df.sparkSession, len(columns)
    if not k:
        return spark.createDataFrame([], "column_a string, column_b string, correlation double")

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                part = b.slice(at, 4_096)
                total = _added(total, _moments(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def of_parts(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((4, k, k))
        for m in group["m"]:
            total = _added(total, np.frombuffer(m).reshape(4, k, k))
        return pd.DataFrame({"part": [0], "m": [total.tobytes()]})

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column("m").to_pylist():
                n, _, square, product = np.frombuffer(m).reshape(4, k, k)
                spread = np.sqrt(np.maximum(square, 0)) * np.sqrt(np.maximum(square.T, 0))
                good = (n > 1) & (spread > 0)
                r = np.where(good, product / np.where(good, spread, 1.0), 0.0)
                first, second = np.repeat(np.arange(k), k), np.tile(np.arange(k), k)
                names = np.array(columns, object)
                yield pa.RecordBatch.from_arrays([pa.array(names[first], pa.string()), pa.array(names[second], pa.string()), pa.array(r.ravel(), mask=~good.ravel())], names=["column_a", "column_b", "correlation"])

    parts = df.select(*[col_num(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(of_rows, "m binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
    # matrices, one per partition and then one per group: a few rows, each of the square of the columns
    parts = parts.groupBy("part").applyInPandas(of_parts, "part int, m binary").groupBy("part").applyInPandas(of_parts, "part int, m binary")
    return parts.mapInArrow(to_rows, "column_a string, column_b string, correlation double")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, frequency): equal-width bins from 1; the maximum is in the last. A column without spread has one bin."""
    v = col_num(df, column)
    values = df.select(v.alias("v")).where(F.col("v").isNotNull())
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = values.join(F.broadcast(edges))  # edges: one row
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)) + 1, F.lit(bins))).otherwise(1)
    counts = placed.groupBy("lo", "hi", number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    return counts.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), "frequency")


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: low, q1, median, q3, high and whiskers at the outermost values within 1.5 interquartile ranges."""
    values = df.select(col_num(df, column).alias("v")).where(F.col("v").isNotNull())
    q = exact_quantiles(values.select(F.lit("v").alias("column_name"), "v"), [0.0, 0.25, 0.5, 0.75, 1.0]).select("q")  # one row
    inside = values.join(F.broadcast(q)).where((F.col("v") >= F.col("q")[1] - 1.5 * (F.col("q")[3] - F.col("q")[1])) & (F.col("v") <= F.col("q")[3] + 1.5 * (F.col("q")[3] - F.col("q")[1])))
    return inside.groupBy("q").agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high")).select(
        F.col("q")[0].alias("low"), F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"), F.col("q")[3].alias("q3"), F.col("q")[4].alias("high"), "whisker_low", "whisker_high"
    )

