"""Column-level data quality profile per load, and the loads that differ from an accepted profile.

Exact base aggregates come from one pass: rows are added up to (load, column, value) counts, from which null counts, distinct counts,
ranges, strays, bands and the most frequent value follow. No load or column is ever one task's group of rows.

Distribution changes are found by a classifier two-sample test. Rows are added up to weighted cells (load, fold, class of every
column), which are sufficient statistics for logistic regressions on class indicators (bands of numbers, accepted values of texts); the regressions that tell a
load from the accepted profile are trained per load, distributed over the cluster, and cross-fitted. With every column alone the classifier's odds are the
density ratio of load and profile: it says by how much each band's share has moved, and that decides on ``distribution``. With all columns, and with each
column left out (ablation), the discrimination (AUC on the fold not trained on) tells how far the columns explain the difference. The exact band shares stand beside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.values import finite, strip

FOLDS = 2
BANDS = 4
#: The regressions over all columns are fitted on at most so many cells of a load, chosen by a hash; those of single columns on all rows.
FIT_CELLS = 20_000
#: Rows of the accepted sample for the regressions over all columns: every column has its accepted shares, independent of the others.
ACCEPTED_ROWS = 4_096
#: A moved share this close to its limit is too close for a fitted ratio; the exact share then decides.
CLOSE = 1e-3
#: Tasks over which the fits of the loads are spread.
FIT_TASKS = 32
SALTS = 16
#: Accepted profiles collected to the driver; one row per column.
MAX_COLUMNS = 10_000


@dataclass(frozen=True)
class Baseline:
    table_name: str
    column_name: str
    null_rate: float | None
    value_min: float | None
    value_max: float | None
    q: tuple
    bands: tuple
    null_limit: float | None
    stray_limit: float | None
    band_limit: float | None
    accepted: list[str] | None

    @property
    def numeric(self) -> bool:
        return self.accepted is None


def read_baselines(df: DataFrame, table: str) -> dict[str, Baseline]:
    rows = df.where(F.col("table_name") == table).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} accepted columns")
    n = lambda x: None if x is None or math.isnan(x) else float(x)
    return {
        r.column_name: Baseline(
            table, r.column_name, n(r.null_rate), n(r.value_min), n(r.value_max), (n(r.q25), n(r.q50), n(r.q75)), (n(r.band1), n(r.band2), n(r.band3), n(r.band4)),
            n(r.null_limit), n(r.stray_limit), n(r.band_limit), r.accepted.split("|") if r.accepted is not None else None,
        ) for r in rows
    }


def band_of(value, b: Baseline):
    """1 to 4 by the accepted quartiles; null for null."""
    q25, q50, q75 = (F.lit(x) for x in b.q)
    return F.when(value <= q25, 1).when(value <= q50, 2).when(value <= q75, 3).when(value.isNotNull(), 4)


def base_aggregates(df: DataFrame, load: str, baselines: dict[str, Baseline]) -> DataFrame:
    """One row per load and column: rows, nulls, distinct values, range, strays, the most frequent value's count and bands.

    NaN, infinite and blank count as null. A null load is a load of its own. An empty table gives an empty result.
    """
    numeric = [b for b in baselines.values() if b.numeric]
    texts = [b for b in baselines.values() if not b.numeric]
    parts = []
    for kind, group in (("double", numeric), ("string", texts)):
        if not group:
            continue
        cells = []
        for b in group:
            c = F.col(f"`{b.column_name}`")
            value = finite(c) if kind == "double" else F.when(strip(c) != "", c)
            stray = ((value < b.value_min) | (value > b.value_max)) if kind == "double" else ~value.isin(b.accepted)
            band = band_of(value, b) if kind == "double" else F.lit(None).cast("int")
            cells.append(F.struct(F.lit(b.column_name).alias("column_name"), value.alias("value"), F.coalesce(stray, F.lit(False)).alias("stray"), band.alias("band")))
        counts = df.select(F.col(load).cast("bigint").alias("load_id"), F.explode(F.array(*cells)).alias("x")).groupBy("load_id", "x.column_name", "x.value", "x.stray", "x.band").agg(F.count(F.lit(1)).alias("n"))
        there = F.col("value").isNotNull()
        text = kind == "string"
        parts.append(
            counts.groupBy("load_id", "column_name").agg(
                F.sum("n").alias("rows"),
                F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("nulls"),
                F.count("value").alias("distinct_values"),
                (F.lit(None).cast("double") if text else F.min("value")).alias("min_value"),
                (F.lit(None).cast("double") if text else F.max("value")).alias("max_value"),
                F.coalesce(F.sum(F.when(F.col("stray"), F.col("n"))), F.lit(0)).alias("strays"),
                F.coalesce(F.max(F.when(there, F.col("n"))), F.lit(0)).alias("top_count"),
                *[F.coalesce(F.sum(F.when(F.col("band") == i, F.col("n"))), F.lit(0)).alias(f"band{i}") for i in range(1, BANDS + 1)],
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _auc(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted area under the ROC curve; ties count half."""
    order = np.argsort(score, kind="stable")
    s, pos, neg = score[order].round(9), (w * y)[order], (w * (1 - y))[order]
    if pos.sum() <= 0 or neg.sum() <= 0:
        return 0.5
    starts = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(starts) - 1
    gp, gn = np.bincount(group, pos), np.bincount(group, neg)
    below = np.cumsum(gn) - gn
    return float((gp * (below + gn / 2)).sum() / (pos.sum() * neg.sum()))


def _dealt(cells: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The rows of the cells dealt out to the folds in turn."""
    cells = cells.groupby(names, as_index=False)["n"].sum().sort_values(names)
    end = cells["n"].cumsum()
    part = lambda f: (end + f) // FOLDS - (end - cells["n"] + f) // FOLDS
    return pd.concat([cells.assign(fold=f, n=part(f)) for f in range(FOLDS)]).query("n > 0")


def _folded(cells: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The cells with every row in a fold: those without a key (fold null), and all if the keys leave a fold under a quarter of the rows, are dealt out in turn."""
    none = cells["fold"].isna()
    if none.any():
        cells = pd.concat([cells.loc[~none, [*names, "fold", "n"]], _dealt(cells[none], names)], ignore_index=True)
        cells = cells.groupby([*names, "fold"], as_index=False)["n"].sum()
    if min(cells.loc[cells["fold"] == f, "n"].sum() for f in range(FOLDS)) < cells["n"].sum() / (2 * FOLDS):
        cells = _dealt(cells, names)
    return cells


def _codes(classes: np.ndarray, sizes: list[int], cols: list[int]) -> np.ndarray:
    """Intercept and one indicator per class of each column but its first."""
    return np.concatenate([np.ones((len(classes), 1)), *[(classes[:, [i]] == np.arange(1, sizes[i])).astype(float) for i in cols]], axis=1)


def accepted_sample(shares: list[np.ndarray], rows: int = ACCEPTED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct class rows and their weights: each column has its shares, in an order of its own (a seeded permutation), so that columns are independent."""
    at = np.stack([np.searchsorted(np.cumsum(s / s.sum()), (np.random.default_rng(i).permutation(rows) + 0.5) / rows).clip(0, len(s) - 1) for i, s in enumerate(shares)], axis=1)
    distinct, n = np.unique(at, axis=0, return_counts=True)
    return distinct, n / rows


def _crossed(cells: np.ndarray, n: np.ndarray, fold: np.ndarray, ref: np.ndarray, ref_weight: np.ndarray, sizes: list[int], cols: list[int]) -> tuple[float | None, np.ndarray]:
    """(cross-fitted AUC or None, the load's weight in each reference row as the fitted odds have it, mean of the folds by rows)."""
    aucs, mass, ratios, trained = 0.0, 0.0, np.zeros(len(ref)), 0.0
    x_ref = _codes(ref, sizes, cols)
    for f in range(FOLDS):
        train, test = fold != f, fold == f
        if not train.any():
            continue
        a = n[train]
        beta = _fit(np.concatenate([_codes(cells[train], sizes, cols), x_ref]), np.r_[np.ones(len(a)), np.zeros(len(ref))], np.r_[a / a.sum(), ref_weight] * a.sum())
        odds = ref_weight * np.exp(np.clip(x_ref @ beta, -30, 30))
        ratios, trained = ratios + odds / odds.sum() * a.sum(), trained + a.sum()
        if test.any():
            b = n[test]
            auc = _auc(np.concatenate([_codes(cells[test], sizes, cols), x_ref]) @ beta, np.r_[np.ones(len(b)), np.zeros(len(ref))], np.r_[b / b.sum(), ref_weight])
            aucs, mass = aucs + auc * b.sum(), mass + b.sum()
    return (aucs / mass if mass else None), (ratios / trained if trained else ref_weight)


def judged(baselines: dict[str, Baseline]) -> list[Baseline]:
    """The columns whose accepted profile has bands and a limit for them, and those with accepted values."""
    return [b for b in baselines.values() if not b.numeric or (b.band_limit is not None and None not in b.bands and None not in b.q)]


def class_of(b: Baseline):
    """0 for null, then bands, or accepted values in their order and one class for all others."""
    c = F.col(f"`{b.column_name}`")
    if b.numeric:
        return F.coalesce(band_of(finite(c), b), F.lit(0))
    place = F.array_position(F.lit(list(b.accepted)), c.cast("string")).cast("int") if b.accepted else F.lit(0)
    return F.when(strip(c.cast("string")) != "", F.when(place > 0, place).otherwise(len(b.accepted) + 1)).otherwise(0)


def discrimination(df: DataFrame, load: str, fold_key: str, baselines: dict[str, Baseline]) -> DataFrame:
    """(load_id, column_name, auc_alone, auc_all, auc_without, moved): the classifier two-sample test of every load.

    ``moved`` is the largest change of a band's share, among values that are there, as the odds of the column's own regression have it. Columns of texts have no accepted shares: they are told from
    those of all loads together, and nothing is said on ``moved``. Keys that are null or much repeated are no folds: such rows are dealt out in turn. What can't be cross-fitted has an AUC of 0.5.
    """
    use = judged(baselines)
    names = [f"c{i}" for i in range(len(use))]
    sizes = [BANDS + 1 if b.numeric else len(b.accepted) + 2 for b in use]
    fold = F.when(F.col(fold_key).isNotNull(), F.pmod(F.xxhash64(F.col(fold_key)), F.lit(FOLDS)).cast("int"))
    cells = df.select(F.col(load).cast("bigint").alias("load_id"), fold.alias("fold"), *[class_of(b).alias(k) for k, b in zip(names, use)]).groupBy("load_id", "fold", *names).agg(F.count(F.lit(1)).alias("n"))
    ones = cells.select("load_id", "fold", "n", F.posexplode(F.array(*names)).alias("i", "class")).groupBy("load_id", "i", "fold", "class").agg(F.sum("n").alias("n"))
    pool = ones.groupBy("i", "class").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("i", "class", "n")).alias("pool"))  # one row, as long as the profiles have classes
    ones = ones.join(F.broadcast(pool)) if any(not b.numeric for b in use) else ones.withColumn("pool", F.lit(None).cast(pool.schema["pool"].dataType))
    order = F.xxhash64(F.lit(7), *names)
    some = Window.partitionBy("load_id", "salt").orderBy(order, "fold", *names)
    joint = cells.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), *names), F.lit(SALTS))).withColumn("k", F.row_number().over(some)).where(F.col("k") <= FIT_CELLS // SALTS).drop("salt", "k")

    def test(both: pd.DataFrame) -> pd.DataFrame:
        load_id = both["load_id"].iloc[0]
        single, group = both[both["i"].notna()], both[both["i"].isna()]
        shares = []
        pooled = single["pool"].iloc[0]
        for i, b in enumerate(use):
            s = np.zeros(sizes[i])
            if b.numeric:
                s[0] = min(max(b.null_rate or 0.0, 0.0), 1.0)
                s[1:] = (1 - s[0]) * np.array(b.bands, float) / sum(b.bands)
            else:
                for x in pooled:
                    if x["i"] == i:
                        s[x["class"]] = x["n"]
            shares.append(s / s.sum())
        group = _folded(group, names)
        classes, n, fold = group[names].to_numpy(int), group["n"].to_numpy(float), group["fold"].to_numpy()
        ref, weight = accepted_sample(shares)
        every = list(range(len(use)))
        auc = lambda cols: 0.5 if not cols or (x := _crossed(classes, n, fold, ref, weight, sizes, cols)[0]) is None else x
        together = auc(every)
        rows = []
        for i, b in enumerate(use):
            own = single[(single["i"] == i) & ((single["class"] > 0) | (not b.numeric))]
            alone, moved = 0.5, None
            if len(own):
                own = _folded(own, ["class"])
                there = np.flatnonzero(shares[i] > 0)
                there = there[there > 0] if b.numeric else there
                accepted = np.maximum(shares[i], 1e-9)[1:] if b.numeric else shares[i][there]
                at = np.arange(1, sizes[i]) if b.numeric else there
                accepted = accepted / accepted.sum()
                got, implied = _crossed(own[["class"]].to_numpy(int), own["n"].to_numpy(float), own["fold"].to_numpy(), at[:, None], accepted, [sizes[i]], [0])
                alone = 0.5 if got is None else got
                moved = float(np.abs(implied - accepted).max()) if b.numeric else None
            rows.append((None if pd.isna(load_id) else int(load_id), b.column_name, alone, together, auc([j for j in every if j != i]), moved))
        return pd.DataFrame(rows, columns=["load_id", "column_name", "auc_alone", "auc_all", "auc_without", "moved"]).astype({"load_id": "Int64", "moved": "float64"})

    schema = "load_id bigint, column_name string, auc_alone double, auc_all double, auc_without double, moved double"
    both = ones.unionByName(joint, allowMissingColumns=True)
    return both.repartition(FIT_TASKS, "load_id").groupBy("load_id").applyInPandas(test, schema)


def load_profile(df: DataFrame, load: str, row_key: str, baselines: dict[str, Baseline]) -> DataFrame:
    """One row per load and column: exact aggregates, discrimination and ``issues`` (array of null_rate, range, stuck, pattern, distribution)."""
    if not baselines:
        raise ValueError("no accepted profile for this table")
    table = next(iter(baselines.values())).table_name
    base = base_aggregates(df, load, baselines)
    if judged(baselines):
        base = base.alias("b").join(discrimination(df, load, row_key, baselines).alias("d"), F.col("b.load_id").eqNullSafe(F.col("d.load_id")) & (F.col("b.column_name") == F.col("d.column_name")), "left")
        base = base.select("b.*", "d.auc_alone", "d.auc_all", "d.auc_without", F.when(~F.isnan("d.moved"), F.col("d.moved")).alias("moved"))
    else:
        base = base.select("*", *[F.lit(None).cast("double").alias(x) for x in ("auc_alone", "auc_all", "auc_without", "moved")])
    of = lambda value: F.try_element_at(F.create_map(*[x for b in baselines.values() for x in (F.lit(b.column_name), F.lit(value(b)).cast("double"))]), F.col("column_name"))
    present = F.col("rows") - F.col("nulls")
    share = lambda c: F.try_divide(F.col(c), present)
    is_text = F.try_element_at(F.create_map(*[x for b in baselines.values() for x in (F.lit(b.column_name), F.lit(not b.numeric))]), F.col("column_name"))
    limit = of(lambda b: b.band_limit)
    off = F.lit(False)
    for i in range(BANDS):
        off = off | F.coalesce(F.abs(share(f"band{i + 1}") - of(lambda b, i=i: b.bands[i])) > limit, F.lit(False))
    changed = F.coalesce(F.when(F.abs(F.col("moved") - limit) > CLOSE, F.col("moved") > limit).when(F.col("moved").isNotNull(), off), F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("nulls") / F.col("rows") > of(lambda b: b.null_limit), "null_rate"),
        F.when(share("strays") > of(lambda b: b.stray_limit), F.when(is_text, "pattern").otherwise("range")),
        F.when(~is_text & (share("top_count") > 0.5), "stuck"),
        F.when(~is_text & changed, "distribution"),
    ))
    return base.select(
        F.lit(table).alias("table_name"), "column_name", "load_id", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_rate"), "distinct_values", "min_value", "max_value",
        "strays", share("strays").alias("stray_share"), "top_count", *[share(f"band{i}").alias(f"band{i}_share") for i in range(1, BANDS + 1)],
        "auc_alone", "auc_all", "auc_without", (F.col("auc_all") - F.col("auc_without")).alias("ablation_loss"), F.col("moved").alias("moved_share"), flags.alias("issues"),
    )
