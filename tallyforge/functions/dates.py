"""Dates in mixed formats without feed information (month first for slashes); built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

from tallyforge.functions.values import strip

#: Pairs of a full-match pattern and the format read with it, tried in order.
FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "y-M-d"), (r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}", "y-M-d H:m"), (r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}", "y-M-d H:m:s"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "y/M/d"), (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}", "y/M/d H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/y"), (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/y H:m"), (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/y H:m:s"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-y"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "M.d.y"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-y"), (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM y"), (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, y"),
    (r"\d{4}\d{2}\d{2}", "yyyyMMdd"), (r"\d{4}", "yyyy"),
]


def parse_date(c: Column, dtype: DataType | None = None) -> Column:
    """Timestamp without a zone, or null. Fractions of seconds and a trailing ``Z`` or offset are dropped."""
    if isinstance(dtype, TimestampNTZType):
        return c
    if isinstance(dtype, (TimestampType, DateType)):
        return c.cast("timestamp_ntz")
    if dtype is not None and not isinstance(dtype, StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = F.regexp_replace(F.regexp_replace(strip(c), r"(:\d{2})(\.\d+)?\s*(Z|UTC|[+-]\d{2}:?\d{2})?$", "$1"), r"(?<=\d)T(?=\d)", " ")
    tries = [F.when(text.rlike(f"^(?:{p})$"), F.try_to_timestamp(F.initcap(text) if "MMM" in f else text, F.lit(f)).cast("timestamp_ntz")) for p, f in FORMATS]
    return F.when(c.rlike(r"\d{4}"), F.coalesce(*tries))  # every format has four digits in a row
