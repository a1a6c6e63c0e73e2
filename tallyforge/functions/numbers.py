"""Safe numbers, exact sums and divisions that follow IEEE rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from tallyforge.functions.values import NUMBER, finite, strip

#: Values beyond this are added as doubles.
EXACT_BELOW = 1e23


def num(c: Column, dtype: DataType | None = None) -> Column:
    """Double, or null where the value is no number; NaN and infinities are null."""
    if dtype is None or isinstance(dtype, StringType):
        text = strip(c.cast("string"))
        return finite(F.when(text.rlike(NUMBER), text).try_cast("double"))
    if isinstance(dtype, (NumericType, BooleanType)):
        return finite(c.cast("double"))
    return F.lit(None).cast("double")


def col_num(df, name: str) -> Column:
    return num(F.col(f"`{name}`"), df.schema[name].dataType)


def total(c: Column) -> Column:
    """Sum as a double; 0.0 of nothing.

    The first four decimal places are added as exact decimals, whatever the order of rows; what is left of each value below them (or the whole of one
    beyond EXACT_BELOW) is added as a double, so that nothing is rounded away. Amounts in cents or their hundredths give the same sum in every order.
    """
    places = F.when(F.abs(c) < EXACT_BELOW, c.try_cast("decimal(28,4)"))
    rest = c - F.coalesce(places.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(places).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; infinite where only b is 0, null for 0 / 0 and nulls."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when((b == 0) & (a > 0), inf).when((b == 0) & (a < 0), -inf)
