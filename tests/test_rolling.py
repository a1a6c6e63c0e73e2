import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyforge.operators.rolling import daily_totals, rolling_totals


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        e = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((i if rnd.random() > 0.05 else None, e, date(2023, 1, 1) + timedelta(rnd.randrange(90)) if rnd.random() > 0.03 else None, rnd.randrange(-500, 900) if rnd.random() > 0.1 else None, "clash"))
    rows += [r for r in rows[:40] if r[0] is not None]  # delivered again
    df = spark.createDataFrame(rows, "entry int, who string, day date, cents int, entity string")
    got = rolling_totals(daily_totals(df, "who", "day", "cents", "entry"), (7, 30)).collect()
    once = {r[0]: r for r in rows if r[0] is not None}
    kept = [r for r in [*once.values(), *(r for r in rows if r[0] is None)] if r[1] and r[2]]
    seen = {(r.entity, r.day): r for r in got}
    assert len(seen) == len(got)
    for e in {r[1] for r in kept}:
        days = [r[2] for r in kept if r[1] == e]
        d = min(days)
        while d <= max(days):
            r = seen.pop((e, d))
            for p in (7, 30):
                inside = [x for x in kept if x[1] == e and d - timedelta(p) < x[2] <= d]
                assert (r[f"total_cents_{p}"], r[f"entries_{p}"]) == (sum(x[3] or 0 for x in inside), len(inside))
                assert abs(r[f"average_cents_{p}"] - sum(x[3] or 0 for x in inside) / p) < 1e-9
            assert r.entries == sum(x[1] == e and x[2] == d for x in kept) and r.first_day == min(days)
            d += timedelta(1)
    assert not seen


def test_empty(spark):
    df = spark.createDataFrame([], "who string, day date, cents bigint")
    assert rolling_totals(daily_totals(df, "who", "day", "cents")).count() == 0


def test_no_shuffle_after_the_explosion(spark):
    df = spark.createDataFrame([("a", date(2023, 1, 1), 5)], "who string, day date, cents bigint")
    plan = rolling_totals(daily_totals(df, "who", "day", "cents"), (7,)).groupBy("entity").agg(F.sum("total_cents_7"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
