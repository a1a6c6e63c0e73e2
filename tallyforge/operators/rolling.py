"""Rolling totals and averages over trailing periods, quiet days included.

Method: each daily total is exploded onto every output day it influences (its own and the following ``period - 1``), the
copies are grouped by entity and day, and calendar rows bring the days without activity as zeros.

Rows are first added up to entity-days, so an entity with a third of all rows brings no more than one row a day to
everything that follows; the explosion multiplies entity-days, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(rows: DataFrame, entity: str, day: str, cents: str, entry: str | None = None) -> DataFrame:
    """(entity, day, cents, entries): exact integer sums.

    Rows whose entity or day is null belong to no entity-day and are left out. Null cents count as 0 but as an entry. With
    ``entry``, rows that repeat an entry id count once (the row smallest by day, entity and cents is taken; repeats are
    expected to agree); a null entry id repeats nothing.
    """
    base = rows.select(F.col(entity).alias("entity"), F.col(day).alias("day"), F.coalesce(F.col(cents), F.lit(0)).cast("bigint").alias("cents"), *([F.col(entry).alias("entry")] if entry else []))
    if entry:
        alone = F.when(F.col("entry").isNull(), F.monotonically_increasing_id())
        base = base.groupBy("entry", alone.alias("alone")).agg(F.min(F.struct("day", "entity", "cents")).alias("r")).select("r.entity", "r.day", "r.cents")
    base = base.where(F.col("entity").isNotNull() & F.col("day").isNotNull())
    return base.groupBy("entity", "day").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("entries"))


def rolling_totals(daily: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and calendar day from its first to its last day with an entry.

    Columns: entity, day, first_day, entries and for each period ``total_cents_P``, ``entries_P`` and ``average_cents_P`` (the
    total divided by P, days before the first count as zero days). Sums are exact integers; an empty table gives an empty result.
    """
    longest = max(periods)
    # one shuffle of the entity-days; the explosion and its grouping then need none, as all days of an entity are together
    daily = daily.repartition("entity")
    span = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    calendar = span.select("entity", "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    spread = daily.select("entity", "day", "cents", "entries", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("age"))
    sums = [F.sum(F.when(F.col("age") == 0, F.col("entries"))).alias("entries")]
    for p in periods:
        inside = F.col("age") < p
        sums += [F.sum(F.when(inside, F.col("cents"))).alias(f"total_cents_{p}"), F.sum(F.when(inside, F.col("entries"))).alias(f"entries_{p}")]
    totals = spread.groupBy("entity", F.date_add("day", F.col("age")).alias("day")).agg(*sums)
    joined = calendar.join(totals, ["entity", "day"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = ["entity", "day", "first_day", zero("entries")]
    for p in periods:
        out += [zero(f"total_cents_{p}"), zero(f"entries_{p}"), (F.coalesce(F.col(f"total_cents_{p}"), F.lit(0)) / F.lit(float(p))).alias(f"average_cents_{p}")]
    return joined.select(*out)
