"""Lazy table behind a view: aggregates and guarded SQL, all returning DataFrames that nothing has collected."""

from __future__ import annotations

import re
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.errors import DestructiveStatement
from tallyforge.session import get_spark, is_uri, suffix_of

#: Plan nodes of queries; every other node anywhere in a statement is refused, so that nothing is changed and no program is run.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Except", "Intersect", "UnresolvedWith", "UnresolvedRelation", "SubqueryAlias", "Join",
    "UnresolvedHaving", "Pivot", "Unpivot", "Generate", "LateralJoin", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "Sample",
    "UnresolvedTableValuedFunction", "Window", "Range", "Offset", "Tail", "UnresolvedOrderedRelation", "UnresolvedTransposeRelation", "UnresolvedHint", "ResolvedInlineTable", "Deduplicate", "UnionLoop",
    "InlineTable", "WithCTE", "CTERelationRef", "UnresolvedTVFAliases", "AsOfJoin",
}
#: Functions that call methods of the virtual machine or tell about the machine.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "version"}
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|`[^`]*`", re.S)


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def _visit(plan, known: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in QUERY_NODES:
        raise DestructiveStatement(kind)
    if kind == "UnresolvedWith":
        known = known | {x._1().lower() for x in _all(plan.cteRelations())}
        for x in _all(plan.cteRelations()):
            _visit(x._2(), known)
    if kind == "UnresolvedRelation":
        parts = _all(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in known:
            raise DestructiveStatement(f"reading {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction":
        _function(_all(plan.name()))
    for e in _all(plan.expressions()):
        _expression(e, known)
    for child in _all(plan.children()):
        _visit(child, known)


def _function(parts: list[str]) -> None:
    if parts[-1].lower() in REFUSED_FUNCTIONS:
        raise DestructiveStatement(f"calling {parts[-1]}")


def _expression(e, known: set[str]) -> None:
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        _function(_all(e.nameParts()))
    if hasattr(e, "plan") and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _visit(e.plan(), known)
    for child in _all(e.children()):
        _expression(child, known)


def check_query(spark: SparkSession, sql: str, relations: tuple[str, ...] = ("data",)) -> None:
    """Refuses everything whose plan isn't a query over the named relations, down to the last subquery; Spark itself refuses several statements in one text."""
    _visit(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), {r.lower() for r in relations})


#: The letters of strftime and what they are in Spark.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "f": "SSSSSS", "%": "%"}


def _pattern(fmt: str) -> str:
    out = "".join(STRFTIME.get(x[1], x) if x[0] == "%" and len(x) > 1 else f"\\'{x}\\'" if x.isalpha() else x for x in re.findall(r"%.|[^%]", fmt, re.S))
    return out.replace("\\'\\'", "")


def to_spark_dialect(sql: str) -> str:
    """Rewrites forms of the other common dialect that Spark doesn't parse: ``EXCLUDE``, ``quantile_cont``, ``date_diff('unit', ...)``, ``strftime``, ``AS TEXT`` and names in double quotes.

    Literals and comments are set aside first, so nothing inside them changes.
    """
    kept: list[str] = []

    def put_aside(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    sql = _LITERAL.sub(put_aside, sql)
    sql = re.sub(r'"((?:[^"]|"")*)"', lambda m: put_aside(re.match(r"(?s).*", "`" + m[1].replace('""', '"').replace("`", "``") + "`")), sql)
    literal = lambda n: kept[int(n)][1:-1]
    sql = re.sub(r"\*\s+EXCLUDE\b", "* EXCEPT", sql, flags=re.I)
    sql = re.sub(r"\bquantile_cont\s*\(", "percentile(", sql, flags=re.I)
    sql = re.sub(r"\bdate_diff\s*\(\s*\x00(\d+)\x00\s*,", lambda m: f"datediff({literal(m[1])},", sql, flags=re.I)
    sql = re.sub(r"\bstrftime\s*\(((?:[^()]|\([^()]*\))*?),\s*\x00(\d+)\x00\s*\)", lambda m: f"date_format({m[1]}, '{_pattern(literal(m[2]))}')", sql, flags=re.I)
    sql = re.sub(r"\bAS\s+TEXT\s*\)", "AS STRING)", sql, flags=re.I)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], sql)


class LargeDataAsset:
    """CSV, Parquet or Excel file, or a DataFrame, as the view ``data`` of its own."""

    def __init__(self, source: str | Path | DataFrame, spark: SparkSession | None = None):
        if isinstance(source, DataFrame):
            self.path, self._df = None, source
        else:
            self.path, spark = source if is_uri(source) else Path(source), spark or get_spark()
            suffix = suffix_of(source)
            if suffix == ".csv":
                self._df = spark.read.csv(str(source), header=True, inferSchema=True)
            elif suffix == ".parquet":
                self._df = spark.read.parquet(str(source))
            elif suffix in (".xlsx", ".xlsm"):
                from tallyforge.sources.loaders import load

                self._df = load(source, spark)[0].drop("_row_id")
            else:
                raise ValueError(f"{suffix}: a lazy view takes .csv, .parquet, .xlsx or .xlsm")
        self._session = self._df.sparkSession
        self._view = f"data_{uuid4().hex}"
        self._df.createOrReplaceTempView(self._view)

    def count(self) -> int:
        return self._df.count()

    def columns(self) -> list[str]:
        return self._df.columns

    def aggregate(self, group_by: str, *exprs: str, where: str | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
        """Grouped expressions; several columns or expressions may stand in ``group_by``; without expressions the rows are counted as ``n``."""
        text = f"SELECT {group_by}, {', '.join(exprs) or 'count(*) AS n'} FROM {self._view}"
        if where:
            text += f" WHERE {where}"
        text += f" GROUP BY {group_by}" + (f" ORDER BY {order_by}" if order_by else "") + (f" LIMIT {int(limit)}" if limit else "")
        check_query(self._session, text, (self._view,))
        return self._session.sql(text)

    def query(self, sql: str) -> DataFrame:
        """Any SQL query over the view ``data``."""
        sql = to_spark_dialect(sql)
        check_query(self._session, sql)
        return self._session.sql(f"WITH data AS (SELECT * FROM {self._view}) SELECT * FROM ({sql.rstrip().rstrip(';')}\n)")

    def sample(self, n: int = 1000) -> DataFrame:
        """The first n rows Spark comes across, not a random sample."""
        return self._df.limit(n)

    def to_pandas(self, limit: int | None = None):
        return (self._df.limit(limit) if limit else self._df).toPandas()

    def close(self) -> None:
        self._session.catalog.dropTempView(self._view)

    def __repr__(self) -> str:
        return f"LargeDataAsset({str(self.path)!r}, {len(self._df.columns)} columns)"


def large(path: str | Path, spark: SparkSession | None = None) -> LargeDataAsset:
    return LargeDataAsset(path, spark)


def as_of_join(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], bucket: str = "1 day") -> DataFrame:
    """For each left row the latest right row of the same key at or before its time; a left row without one gets nulls.

    Union and a window over (key, time bucket), with one summary row per bucket carried over later buckets, so a hot key is no one task's group.
    A null time or key matches nothing. Right rows of equal time: the largest values win.
    """
    keys = [F.col(k) for k in by]
    seen = F.struct(F.col(time).alias("_time"), *[F.col(v).alias(v) for v in values])
    a = left.select(*[F.col(c) for c in left.columns], F.lit(None).cast(right.select(seen.alias("x")).schema["x"].dataType).alias("_seen"), F.lit(1).alias("_side"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time), seen.alias("_seen"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", F.window(F.coalesce(F.col(time).cast("timestamp"), F.timestamp_seconds(F.lit(0))), bucket)["start"])
    from pyspark.sql import Window

    here = Window.partitionBy(*by, "_bucket").orderBy(time, "_side", "_seen").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(here))
    carried = b.withColumn("_bucket", F.window(F.col(time).cast("timestamp"), bucket)["start"])
    ends = both.select(*by, "_bucket").distinct().join(carried.groupBy(*by, "_bucket").agg(F.max("_seen").alias("_end")), [*by, "_bucket"], "left")
    past = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(past)).select(*by, "_bucket", "_before")
    out = both.where(F.col("_side") == 1).join(ends, [*by, "_bucket"], "left").withColumn("_hit", F.when(F.col(time).isNotNull(), F.coalesce("_last", "_before")))
    return out.select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])
