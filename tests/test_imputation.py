import random

from pyspark.sql import functions as F

from tallyforge.operators.imputation import fill_over_time


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, who string, at timestamp, x double, c string, _s string")
    return {
        r.id: r
        for r in fill_over_time(df, "who", "at", "id", {"x": F.col("x")}, {"c": F.col("c")}, {"x": F.col("x").isNull(), "c": F.col("c").isNull()}, **kw).collect()
    }


def brute(rows, limit):
    out = {}
    for e in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == e), key=lambda r: (r[2].timestamp() if r[2] else 0.0, r[0]))
        sec = [r[2].timestamp() if r[2] else 0.0 for r in group]
        for i, r in enumerate(group):
            for col, k in (("x", 3), ("c", 4)):
                if r[k] is not None or e is None:
                    out[r[0], col] = (r[k], False, None)
                    continue
                p = next((j for j in range(i, -1, -1) if group[j][k] is not None), None)
                n = next((j for j in range(i, len(group)) if group[j][k] is not None), None)
                if p is None and n is None:
                    out[r[0], col] = (None, False, None)
                elif col == "x":
                    if p is None or n is None:
                        j = n if p is None else p
                        values = [g[k] for g in group if g[k] is not None]
                        out[r[0], col] = (group[j][k], True, "carried") if abs(sec[i] - sec[j]) <= limit else (sum(values) / len(values), True, "average")
                    else:
                        a, b = group[p][k], group[n][k]
                        out[r[0], col] = (a + (b - a) * (sec[i] - sec[p]) / (sec[n] - sec[p]) if sec[n] > sec[p] else (a + b) / 2, True, "interpolated")
                else:
                    back = sec[i] - sec[p] if p is not None else float("inf")
                    ahead = sec[n] - sec[i] if n is not None else float("inf")
                    if min(back, ahead) <= limit:
                        out[r[0], col] = (group[p if back <= ahead else n][k], True, "carried")
                    else:
                        values = [g[k] for g in group if g[k] is not None]
                        out[r[0], col] = (min(set(values), key=lambda v: (-values.count(v), v)), True, "frequent")
    return out


def test_against_one_window_per_entity(spark):
    from datetime import UTC, datetime, timedelta

    rnd = random.Random(9)
    t0 = datetime(2023, 1, 1, tzinfo=UTC)
    rows = []
    for i in range(500):
        who = rnd.choice(["hot"] * 5 + ["a", "b", None, "none"])
        at = t0 + timedelta(seconds=rnd.choice([3600, 60]) * rnd.randrange(2_000)) if rnd.random() > 0.02 else None
        seen = who != "none"
        rows.append((i, who, at, rnd.random() * 100 if seen and rnd.random() > 0.5 else None, rnd.choice("pqr") if seen and rnd.random() > 0.6 else None, "own"))
    got = run(spark, rows, carry_limit=7_200)
    for (i, col), (value, filled, method) in brute(rows, 7_200).items():
        r = got[i]
        assert (r[f"{col}_filled"], r[f"{col}_method"]) == (filled, method), (i, col)
        if col == "x" and value is not None:
            assert abs(r.x_value - value) < 1e-6
        else:
            assert r[f"{col}_value"] == value
        assert r["_s"] == "own"
    assert len(got) == len(rows)


def test_empty_and_equal_times(spark):
    from datetime import datetime

    assert run(spark, []) == {}
    t = datetime(2023, 1, 1)
    got = run(spark, [(1, "a", t, 2.0, "p", None), (2, "a", t, None, None, None), (3, "a", t, 4.0, "q", None)])
    assert (got[2].x_value, got[2].c_value, got[2].x_distance) == (3.0, "p", 0.0)
