"""Reads a file by its suffix into a DataFrame with a row id, and facts about the reading."""

from __future__ import annotations

import codecs
import io
import sqlite3
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.errors import DestructiveStatement, UnsupportedFileType
from tallyforge.operators.quality import ROW_ID, flatten, with_row_id
from tallyforge.session import get_spark, is_uri, suffix_of
from tallyforge.sources import datasources

SUPPORTED = [".csv", ".xlsx", ".xlsm", ".json", ".parquet", ".sql", ".db", ".sqlite", ".duckdb"]
REMOTE = [".csv", ".json", ".parquet"]
#: Cells of a CSV file that are null.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ENCODINGS = ["utf-8", "utf-8-sig", "cp1252", "latin-1"]
SPARK_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
DESTRUCTIVE = ["DROP", "TRUNCATE", "DELETE", "ALTER"]
_DECODE_BLOCK = 1 << 20


def detect_encoding(path: Path) -> str:
    """The first encoding that decodes the whole file without an error, read in blocks; a byte order mark means utf-8-sig."""
    with path.open("rb") as f:
        if f.read(3) == codecs.BOM_UTF8:
            return "utf-8-sig"
    for name in ENCODINGS:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with path.open("rb") as f:
                while block := f.read(_DECODE_BLOCK):
                    decoder.decode(block)
                decoder.decode(b"", True)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get .1, .2, ...; empty ones a number."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"Unnamed: {i}"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def infer(df: DataFrame, columns: list[str], skip: Column | None = None) -> tuple[DataFrame, int]:
    """Text columns as boolean, bigint or double where every value is one, and the number of rows where ``skip`` holds, which are left out; one aggregate job over all columns."""
    q = lambda c: F.col(f"`{c}`")
    skip = F.lit(False) if skip is None else skip
    integer, decimal = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
    # cells as (position, text), so that the plan doesn't grow with the columns; the last one marks a row left out
    cells = df.select(F.posexplode(F.array(*[F.when(~skip, q(c)) for c in columns], F.when(skip, F.lit(""))))).where(F.col("col").isNotNull())
    t = F.trim("col")
    kind = F.when(t.rlike(integer), 1).when(t.rlike(decimal), 2).when(F.lower("col").isin("true", "false"), 4).otherwise(8)
    r = {x.pos: x for x in cells.groupBy("pos").agg(F.bit_or(kind).alias("kinds"), F.count(F.lit(1)).alias("n")).collect()}
    skipped = r[len(columns)].n if len(columns) in r else 0
    out = []
    for i, c in enumerate(columns):
        kinds, t = r[i].kinds if i in r else 0, F.trim(q(c))
        word = F.lower(t)
        infinite = F.when(word.rlike(r"^\+?inf"), float("inf")).when(word.rlike("^-inf"), float("-inf"))
        if kinds == 4:
            out.append(q(c).cast("boolean").alias(c))
        elif kinds == 1:
            out.append(t.cast("bigint").alias(c))
        elif kinds in (2, 3):
            out.append(F.coalesce(infinite, t.try_cast("double")).alias(c))
        else:
            out.append(q(c))
    kept = df.where(~F.coalesce(skip, F.lit(False))) if skipped else df
    return kept.select(*out, *[q(c) for c in df.columns if c not in columns]), skipped


def csv_facts(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether quotes span lines), from one parallel pass over the lines.

    The encoding is the first of ENCODINGS that decodes every line. Where every line holds an even number of quotes, every line starts outside of them, and a file can be cut at any line.
    """
    v = F.col("value")
    sound = F.is_valid_utf8(v)
    undefined = F.hex(v.cast("binary")).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    quotes = F.octet_length(v) - F.octet_length(F.replace(v, F.lit('"'), F.lit("")))
    r = spark.read.text(path).agg(F.count_if(~sound).alias("bad"), F.count_if(F.when(~sound, undefined)).alias("undefined"), F.count_if(quotes % 2 == 1).alias("open")).first()
    if r.bad:
        return ("latin-1" if r.undefined else "cp1252"), r.open > 0
    return ("utf-8-sig" if first_bytes(spark, path, 3) == codecs.BOM_UTF8 else "utf-8"), r.open > 0


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """Of a file of any file system; nothing of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.getFileStatus(where).isFile():
        return b""
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows with too many fields are skipped and counted in the encoding label; short rows are padded with nulls. A file is one task only where quotes span lines."""
    encoding, spans = csv_facts(spark, path)
    how = {"encoding": SPARK_NAMES[encoding], "quote": '"', "escape": '"', "multiLine": spans}
    head = spark.read.csv(path, header=False, **how).limit(1).collect()
    if not head or not len(head[0]):
        return spark.createDataFrame([], "empty string").drop("empty"), {"encoding": encoding}
    names = unique_names([(x or "").lstrip("\ufeff") for x in head[0]])
    over = "_more_fields"
    schema = StructType([StructField(n, StringType()) for n in [*names, over]])
    raw = with_row_id(spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=True, **how))
    body = raw.select(*[F.when(~F.col(f"`{n}`").isin(NA_TOKENS), F.col(f"`{n}`")).alias(n) for n in names], over, ROW_ID)
    df, skipped = infer(body, names, F.col(over).isNotNull())
    label = f"{encoding} (skipped {skipped} malformed rows)" if skipped else encoding
    return df.drop(over), {"encoding": label, "skipped_rows": skipped}


def split_script(text: str) -> list[str]:
    """Statements of a script, split at ``;`` outside quotes and comments; comments are dropped."""
    out, cur, i = [], io.StringIO(), 0
    while i < len(text):
        ch = text[i]
        if ch in "'\"`":
            end = i + 1
            while end < len(text) and text[end] != ch:
                end += 1
            cur.write(text[i : end + 1])
            i = end + 1
        elif text.startswith("--", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else len(text)
        elif ch == ";":
            out.append(cur.getvalue().strip())
            cur = io.StringIO()
            i += 1
        else:
            cur.write(ch)
            i += 1
    return [s for s in [*out, cur.getvalue().strip()] if s]


def check_script(text: str) -> list[str]:
    statements = split_script(text)
    for s in statements:
        word = s.split(None, 1)[0].upper()
        if word in DESTRUCTIVE:
            raise DestructiveStatement(word)
    return statements


def read_script(spark: SparkSession, path: Path) -> tuple[DataFrame, dict]:
    """Runs CREATE and INSERT in an in-memory database of the script's own and returns its last query. A script is driver-sized by nature."""
    import duckdb

    last = None
    statements = check_script(path.read_text(encoding=detect_encoding(path)))
    with duckdb.connect(":memory:") as con:
        for s in statements:
            word = s.split(None, 1)[0].upper()
            if word in ("CREATE", "INSERT"):
                con.execute(s)
            elif word in ("SELECT", "WITH", "FROM"):
                last = con.execute(s).df()
    if last is None:
        raise ValueError(f"{path}: the script has no query")
    last = last.astype(object).where(last.notna(), None)
    kinds = [StructField(c, datasources.guess([v for v in last[c] if v is not None])) for c in last.columns]
    rows = [tuple(datasources.fit_value(v, k.dataType) for v, k in zip(r, kinds)) for r in last.itertuples(index=False)]
    return spark.createDataFrame(rows, StructType(kinds)), {"statements": len(statements)}


def largest_sqlite_table(path: Path) -> str:
    best, name = -1, None
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall():
            try:
                n = con.execute(f"SELECT count(*) FROM {datasources.quote(t)}").fetchone()[0]
            except sqlite3.Error:
                n = 0
            if n > best:
                best, name = n, t
    if name is None:
        raise ValueError(f"{path}: no table")
    return name


def first_duckdb_table(path: Path) -> str:
    import duckdb

    with duckdb.connect(str(path), read_only=True) as con:
        rows = con.execute("SELECT table_name FROM information_schema.tables ORDER BY table_name LIMIT 1").fetchall()
    if not rows:
        raise ValueError(f"{path}: no table")
    return rows[0][0]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records or one record per line; columns named like times become timestamps if every value is one."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    df = spark.read.json(path, multiLine=bool(head) and head[0].value.lstrip("\ufeff \t").startswith("["))
    timed = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and (f.name.lower() in ("date", "modified") or f.name.lower().startswith("timestamp") or f.name.lower().endswith(("_at", "_time")))]
    if timed:
        parsed = {c: F.try_to_timestamp(F.col(f"`{c}`")).cast("timestamp_ntz") for c in timed}
        r = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & parsed[c].isNull()).alias(f"b{i}") for i, c in enumerate(timed)]).first()
        df = reduce(lambda d, x: d.withColumn(x[1], parsed[x[1]]) if not r[f"b{x[0]}"] else d, enumerate(timed), df)
    return df


def load(path: str | Path, spark: SparkSession | None = None) -> tuple[DataFrame, dict]:
    """(table with ROW_ID, facts). NaN is null, nested columns are JSON text. ``path`` may be a file, a folder of such files or, for csv, json and parquet, a URI of any file system Spark knows."""
    remote, suffix = is_uri(path), suffix_of(path)
    if not remote:
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(path)
    if suffix not in SUPPORTED:
        raise UnsupportedFileType(path, SUPPORTED)
    if remote and suffix not in REMOTE:
        raise ValueError(f"{path}: only {', '.join(REMOTE)} are read from other file systems")
    spark = spark or get_spark()
    meta: dict = {"path": str(path), "format": suffix.lstrip(".")}
    datasources.register(spark)
    if suffix == ".csv":
        df, more = read_csv(spark, str(path))
        meta |= more
    elif suffix in (".xlsx", ".xlsm"):
        df = spark.read.format("tally_xlsx").load(str(path))
    elif suffix == ".json":
        df = read_json(spark, str(path))
    elif suffix == ".parquet":
        df = spark.read.parquet(str(path))
    elif suffix == ".sql":
        df, more = read_script(spark, path)
        meta |= more
    elif suffix in (".db", ".sqlite"):
        meta["table"] = largest_sqlite_table(path)
        df = spark.read.format("tally_sqlite").option("dbtable", meta["table"]).load(str(path))
    else:
        meta["table"] = first_duckdb_table(path)
        df = spark.read.format("tally_duckdb").option("dbtable", meta["table"]).load(str(path))
    return with_row_id(flatten(df)), meta
