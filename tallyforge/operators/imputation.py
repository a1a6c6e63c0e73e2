"""Filling missing values from similar records: time-ordered filling per entity.

Numbers are interpolated in time between the observed neighbours of the same entity; before the first and after the last observation, and for categories, the
nearer neighbour is carried within a gap limit. Beyond the limit the typical value of the entity is taken (the average number, the most frequent category), so that
every cell with a usable value of its entity comes out filled. Each filled value carries its method and the distance in seconds to the nearest observation.

An entity can hold a third of all rows, so no window runs over a whole entity: windows run over (entity, time block), and only
one summary row per block (its first and last observed value) goes into a window per entity. Results are the same as those of one
window, as an observation before a block is the last one of the nearest earlier block that has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import total

#: Length of a time block in seconds; an entity-block is one task's group.
BLOCK_SECONDS = 3_600
#: Gap limit for carried values.
CARRY_LIMIT_SECONDS = 30 * 86_400


def fill_over_time(
    df: DataFrame, entity: str, time: str, tie: str, numeric: dict[str, Column], categorical: dict[str, Column],
    missing: dict[str, Column], carry_limit: int = CARRY_LIMIT_SECONDS, block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """All rows and columns of ``df`` plus, per filled column c, c_value, c_filled (boolean), c_method and c_distance (seconds).

    numeric and categorical give the usable value of each column (null where there is none), missing the condition that a cell
    has to be filled; cells that are neither missing nor usable stay null and unfilled. Order within an entity is ``time``, then
    the unique ``tie``; a null time sorts first. Methods: ``interpolated``, ``carried`` (within the limit), ``average`` and ``frequent`` (beyond it). Rows without an
    entity keep null and method null. Ties between two equally near categories go to the earlier one; the most frequent value is the smallest of those
    with the highest count.
    """
    columns = [*numeric, *categorical]
    keep = [c for c in df.columns if c not in {f"{c}_{x}" for c in columns for x in ("value", "filled", "method", "distance")}]
    seconds = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6), F.lit(0.0))
    cells = [x for c in columns for x in ((numeric | categorical)[c].alias(f"_v_{c}"), missing[c].alias(f"_m_{c}"))]
    # columns of the input travel as one struct, so none of their names can clash
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{entity}`").alias("_entity"), F.col(f"`{tie}`").alias("_tie"), seconds.alias("_s"), *cells)
    df = df.withColumn("_block", F.floor(F.col("_s") / block_seconds))
    entity, tie = "_entity", "_tie"
    for c in columns:
        df = df.withColumn(f"_o_{c}", F.when(F.col(f"_v_{c}").isNotNull(), F.struct(F.col("_s").alias("s"), F.col(f"_v_{c}").alias("v"))))
    base = df
    inside = Window.partitionBy(entity, "_block").orderBy("_s", tie)
    before, after = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for c in columns:
        df = df.withColumn(f"_p_{c}", F.last(f"_o_{c}", ignorenulls=True).over(before))
        df = df.withColumn(f"_n_{c}", F.first(f"_o_{c}", ignorenulls=True).over(after))
    # one row per entity-block: what its neighbours need to know of it
    order = F.struct("_s", tie)
    summary = base.where(F.col(entity).isNotNull()).groupBy(entity, "_block").agg(
        *[F.min_by(f"_o_{c}", F.when(F.col(f"_o_{c}").isNotNull(), order)).alias(f"_f_{c}") for c in columns],
        *[F.max_by(f"_o_{c}", F.when(F.col(f"_o_{c}").isNotNull(), order)).alias(f"_l_{c}") for c in columns],
    )
    blocks = Window.partitionBy(entity).orderBy("_block")
    past, future = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    summary = summary.select(
        F.col(entity).alias("_e"), F.col("_block").alias("_b"),
        *[F.last(f"_l_{c}", ignorenulls=True).over(past).alias(f"_pp_{c}") for c in columns],
        *[F.first(f"_f_{c}", ignorenulls=True).over(future).alias(f"_nn_{c}") for c in columns],
    )
    for c in categorical:  # counts are added up before the choice, so a hot entity brings one row per distinct value
        counts = base.where(F.col(entity).isNotNull() & F.col(f"_v_{c}").isNotNull()).groupBy(F.col(entity).alias("_ce"), F.col(f"_v_{c}").alias("_cv")).count()
        best = counts.groupBy("_ce").agg(F.min_by("_cv", F.struct(-F.col("count"), "_cv")).alias(f"_top_{c}"))
        summary = summary.join(best, F.col("_e") == F.col("_ce"), "left").drop("_ce")
    if numeric:
        means = base.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("_ce")).agg(*[F.try_divide(total(F.col(f"_v_{c}")), F.count(f"_v_{c}")).alias(f"_top_{c}") for c in numeric])
        summary = summary.join(means, F.col("_e") == F.col("_ce"), "left").drop("_ce")
    df = df.join(summary, (df[entity] == F.col("_e")) & (df["_block"] == F.col("_b")), "left")
    out = []
    for c in columns:
        prev, nxt = F.coalesce(f"_p_{c}", f"_pp_{c}"), F.coalesce(f"_n_{c}", f"_nn_{c}")
        back, ahead = F.col("_s") - prev["s"], nxt["s"] - F.col("_s")
        fill_it = F.col(f"_m_{c}") & F.col(entity).isNotNull() & (prev.isNotNull() | nxt.isNotNull())
        nearer = F.when(nxt.isNull() | (back <= ahead), prev).otherwise(nxt)
        near = F.least(back, ahead)
        if c in numeric:
            span = nxt["s"] - prev["s"]
            between = F.when(span > 0, prev["v"] + (nxt["v"] - prev["v"]) * F.try_divide(back, span)).otherwise((prev["v"] + nxt["v"]) / 2)
            inside = prev.isNotNull() & nxt.isNotNull()
            value = F.when(inside, between).when(near <= carry_limit, nearer["v"]).otherwise(F.col(f"_top_{c}"))
            method = F.when(inside, "interpolated").when(near <= carry_limit, "carried").otherwise("average")
        else:
            value = F.when(near <= carry_limit, nearer["v"]).otherwise(F.col(f"_top_{c}"))
            method = F.when(near <= carry_limit, "carried").otherwise("frequent")
        out += [
            F.when(fill_it, value).otherwise(F.col(f"_v_{c}")).alias(f"{c}_value"),
            F.coalesce(fill_it, F.lit(False)).alias(f"{c}_filled"),
            F.when(fill_it, method).alias(f"{c}_method"),
            F.when(fill_it, near).alias(f"{c}_distance"),
        ]
    return df.select(*[F.col("_row").getField(c).alias(c) for c in keep], *out)
