"""Python data sources for files Spark has no reader for: xlsx (first sheet), SQLite and DuckDB tables.

SQLite and DuckDB tables are read in row ranges, one partition each, so a large table is spread over the executors (which must see
the file). A sheet is one compressed XML stream and is read by one task in batches.
"""

from __future__ import annotations

import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

ROWS_PER_PARTITION = 500_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def ranges(first: int, last: int) -> list[RowRange]:
    return [RowRange(a, min(a + ROWS_PER_PARTITION, last + 1)) for a in range(first, last + 1, ROWS_PER_PARTITION)] or [RowRange(0, 0)]


def guess(values: list) -> object:
    """Narrowest type that holds all values."""
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return BooleanType()
    if kinds and kinds <= {int}:
        return LongType()
    if kinds and kinds <= {int, float}:
        return DoubleType()
    return StringType()


def fit_value(v, kind):
    if v is None:
        return None
    if isinstance(kind, StringType):
        return v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    return float(v) if isinstance(kind, DoubleType) else v


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(path: str) -> Iterator[list]:
    """Cell values of the first sheet, row by row; dates stay serial numbers unless written as text."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for _, el in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if el.tag == _NS + "si":
                    shared.append("".join(t.text or "" for t in el.iter(_NS + "t")))
                    el.clear()
        book = ElementTree.parse(z.open("xl/workbook.xml"))
        first = book.find(f"{_NS}sheets/{_NS}sheet").get(_REL)
        rels = ElementTree.parse(z.open("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.getroot() if r.get("Id") == first)
        sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for _, el in ElementTree.iterparse(z.open(sheet)):
            if el.tag != _NS + "row":
                continue
            row: list = []
            for cell in el.iter(_NS + "c"):
                at = _column(cell.get("r")) if cell.get("r") else len(row)
                row += [None] * (at + 1 - len(row))
                kind, v = cell.get("t"), cell.find(_NS + "v")
                text = v.text if v is not None else None
                if kind == "inlineStr":
                    row[at] = "".join(t.text or "" for t in cell.iter(_NS + "t"))
                elif text is None:
                    continue
                elif kind == "s":
                    row[at] = shared[int(text)]
                elif kind == "b":
                    row[at] = text == "1"
                elif kind in ("str", "e"):
                    row[at] = text
                else:
                    x = float(text)
                    row[at] = int(x) if x.is_integer() and "." not in text and "E" not in text else x
            yield row
            el.clear()


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, partition):
        kinds = [f.dataType for f in self.schema.fields]
        rows = sheet_rows(self.path)
        next(rows, None)
        for row in rows:
            row = (row + [None] * len(kinds))[: len(kinds)]
            yield tuple(fit_value(v, k) for v, k in zip(row, kinds))


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_xlsx"

    def schema(self) -> StructType:
        rows = sheet_rows(self.options["path"])
        head = next(rows, [])
        columns: list[set] = [set() for _ in head]
        sample: list[list] = [[] for _ in head]
        for row in rows:
            for i, v in enumerate(row[: len(head)]):
                if type(v) not in columns[i]:
                    columns[i].add(type(v))
                    sample[i].append(v)
        return StructType([StructField(str(h) if h is not None else f"column_{i}", guess(sample[i])) for i, h in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {quote(self.table)}").fetchone()
        return ranges(lo, hi) if lo is not None else [RowRange(0, 0)]

    def read(self, partition):
        kinds = [f.dataType for f in self.schema.fields]
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        for row in con.execute(f"SELECT {', '.join(quote(f.name) for f in self.schema.fields)} FROM {quote(self.table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.start, partition.end)):
            yield tuple(fit_value(v, k) for v, k in zip(row, kinds))
        con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            table = quote(self.options["dbtable"])
            fields = []
            for _, name, *_ in con.execute(f"PRAGMA table_info({table})"):
                kinds = {k for (k,) in con.execute(f"SELECT DISTINCT typeof({quote(name)}) FROM {table}")} - {"null"}
                fields.append(StructField(name, LongType() if kinds == {"integer"} else DoubleType() if kinds and kinds <= {"integer", "real"} else StringType()))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["dbtable"], schema)


class DuckReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self):
        import duckdb

        with duckdb.connect(self.path, read_only=True) as con:
            hi = con.execute(f"SELECT max(rowid) FROM {quote(self.table)}").fetchall()[0][0]
        return ranges(0, hi) if hi is not None else [RowRange(0, 0)]

    def read(self, partition):
        import duckdb

        kinds = [f.dataType for f in self.schema.fields]
        with duckdb.connect(self.path, read_only=True, config={"threads": 1}) as con:
            got = con.execute(f"SELECT {', '.join(quote(f.name) for f in self.schema.fields)} FROM {quote(self.table)} WHERE rowid >= ? AND rowid < ?", [partition.start, partition.end])
            while batch := got.fetchmany(10_000):
                for row in batch:
                    yield tuple(fit_value(v, k) for v, k in zip(row, kinds))


class DuckSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_duckdb"

    def schema(self) -> StructType:
        import duckdb
        from pyspark.sql.types import DateType, TimestampNTZType

        kinds = {"BIGINT": LongType(), "INTEGER": LongType(), "SMALLINT": LongType(), "TINYINT": LongType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType(), "BOOLEAN": BooleanType(), "DATE": DateType(), "TIMESTAMP": TimestampNTZType()}
        with duckdb.connect(self.options["path"], read_only=True) as con:
            rows = con.execute("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = ? ORDER BY ordinal_position", [self.options["dbtable"]]).fetchall()
        return StructType([StructField(n, DoubleType() if t.startswith("DECIMAL") else kinds.get(t, StringType())) for n, t in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DuckReader(self.options["path"], self.options["dbtable"], schema)


def register(spark: SparkSession) -> None:
    for source in (XlsxSource, SqliteSource, DuckSource):
        spark.dataSource.register(source)
