from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.timestamps import TimestampParser, issues, zone_intervals

CASES = [
    # text, feed, status, issue, utc, day_shift
    ("2023-01-05", "us", "ok", None, "2023-01-05 00:00:00", False),
    ("01/05/2023", "us", "ok", None, "2023-01-05 00:00:00", False),
    ("01/05/2023", "eu", "ok", None, "2023-05-01 00:00:00", False),
    ("22/07/2022", "us", "invalid", None, None, False),
    ("01.05.2023", "us", "ok", None, "2023-05-01 00:00:00", False),
    ("2023/1/5 3:07 PM", "utc", "ok", None, "2023-01-05 15:07:00", False),
    ("12:30 AM", "utc", "invalid", None, None, False),
    ("Jan 5, 2023 12:30 AM", "utc", "ok", None, "2023-01-05 00:30:00", False),
    ("5 JAN 2023 09:16:31.5", "utc", "ok", None, "2023-01-05 09:16:31.5", False),
    ("05-Jan-2023 21:00", "us", "ok", None, "2023-01-06 02:00:00", True),
    ("20230105", "us", "ok", None, "2023-01-05 00:00:00", False),
    ("2023-01-05" + " " * 150 + "10:00 Z", "us", "ok", None, "2023-01-05 10:00:00", False),
    ("2023-01-05 10:00" + " " * 100_000 + "Z", "us", "ok", None, "2023-01-05 10:00:00", False),
    ("2023-01-05" + "\u0001" * 25, "us", "invalid", None, None, False),
    ("1672912800", "us", "ok", None, "2023-01-05 10:00:00", False),
    ("1672912800123", "us", "ok", None, "2023-01-05 10:00:00.123", False),
    ("Sun, 24 Jul 2022 23:56:16 -0500", "eu", "ok", None, "2022-07-25 04:56:16", True),
    ("2022-07-24T02:03:01+0300", "us", "ok", None, "2022-07-23 23:03:01", True),
    ("2022-07-24T02:03:01+05:45[Asia/Kathmandu]", "us", "ok", None, "2022-07-23 20:18:01", True),
    ("2022-07-24 02:03:01 Z", "au", "ok", None, "2022-07-24 02:03:01", False),
    ("08/04/2022 09:52:59 EDT", "us", "ok", None, "2022-08-04 13:52:59", False),
    ("2022-08-04 09:52:59 CEST", "eu", "ok", None, "2022-08-04 07:52:59", False),
    ("2022-08-04 09:52:59 CEST", "us", "invalid", None, None, False),
    ("2022-03-13 02:30", "us", "ok", "gap", "2022-03-13 07:30:00", False),
    ("2022-03-13 02:30:00 EST", "us", "ok", None, "2022-03-13 07:30:00", False),
    ("2022-11-06 01:30", "us", "ok", "fold", "2022-11-06 05:30:00", False),
    ("2022-10-02 02:30", "au", "ok", "gap", "2022-10-01 16:30:00", True),
    ("2022-10-30 02:00", "eu", "ok", "fold", "2022-10-30 00:00:00", False),
    ("2022-10-30 03:00", "eu", "ok", None, "2022-10-30 02:00:00", False),
    ("2022-02-30", "us", "invalid", None, None, False),
    ("2024-02-29", "us", "ok", None, "2024-02-29 00:00:00", False),
    ("2023-08-11 27:44:00", "us", "invalid", None, None, False),
    ("2023-08-11 13:44 PM", "us", "invalid", None, None, False),
    ("0000-00-00 00:00:00", "us", "invalid", None, None, False),
    ("1999-01-01", "us", "invalid", None, None, False),
    ("2022-1O-26", "us", "invalid", None, None, False),
    ("next Tuesday", "us", "invalid", None, None, False),
    ("x" * 100_000, "us", "invalid", None, None, False),
    ("  \t", "us", "missing", None, None, False),
    (None, "us", "missing", None, None, False),
    ("k.A.", "eu", "missing", None, None, False),
    ("-9999", "au", "missing", None, None, False),
    ("-9999", "us", "invalid", None, None, False),
    ("N/A", "us", "missing", None, None, False),
    ("2023-01-05 10:00", None, "unresolved", None, None, False),
    ("2023-01-05 10:00", "lost", "unresolved", None, None, False),
    ("2023-01-05 10:00", "odd", "unresolved", None, None, False),
    ("2023-01-05 10:00Z", None, "ok", None, "2023-01-05 10:00:00", False),
    ("03/04/2023", None, "unresolved", None, None, False),
    ("23/04/2023", None, "ok", None, "2023-04-23 00:00:00", False),
]


def test_spellings(spark, feeds):
    df = spark.createDataFrame([(i, c[0], c[1], "kept") for i, c in enumerate(CASES)], "i int, text string, feed string, _t string")
    p = TimestampParser(spark, feeds.unionByName(feeds), (2021, 2025))
    out = p.parse(df, "text").select("i", "_t", "ts.*", F.date_format("ts.utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("shown")).orderBy("i").collect()
    assert len(out) == len(CASES)
    for r, (text, feed, status, issue, utc, shift) in zip(out, CASES):
        want = datetime.fromisoformat(utc).strftime("%Y-%m-%d %H:%M:%S.%f") if utc else None
        assert (r.status, r.issue, r.shown, r.day_shift, r["_t"]) == (status, issue, want, shift, "kept"), (text and text[:50], feed)


def test_empty_table(spark, feeds):
    df = spark.createDataFrame([], "text string, feed string")
    assert TimestampParser(spark, feeds, (2021, 2025)).parse(df, "text").count() == 0
    assert TimestampParser(spark, feeds.limit(0)).parse(spark.createDataFrame([("2023-01-05", "us")], "text string, feed string"), "text").first().ts.status == "ok"


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "Australia/Lord_Howe"])
def test_intervals_agree_with_the_clock(zone):
    exploded, _ = zone_intervals([zone], 2021, 2025)
    by_month = {m: spans for _, m, spans in exploded}
    info, epoch, t = ZoneInfo(zone), datetime(1970, 1, 1), datetime(2021, 1, 1)
    while t < datetime(2026, 1, 1):
        us = int((t - epoch).total_seconds()) * 1_000_000
        hits = [off for s, e, off in by_month[t.year * 12 + t.month - 1] if s <= us < e]
        want = []
        for fold in (0, 1):
            local = t.replace(tzinfo=info, fold=fold)
            if local.astimezone(UTC).astimezone(info).replace(tzinfo=None) == t:
                off = int(local.utcoffset().total_seconds())
                want += [off] if off not in want else []
        assert sorted(hits) == sorted(want), t
        t += timedelta(minutes=30) if t.month in (3, 4, 10, 11) else timedelta(hours=13)


def test_issues(spark, feeds):
    df = spark.createDataFrame([("2022-10-02 02:30", "au"), ("nope", "au"), (None, "au")], "text string, feed string")
    rows = TimestampParser(spark, feeds, (2021, 2025)).parse(df, "text").select(issues("ts").alias("x")).collect()
    assert [r.x for r in rows] == [["gap", "day_shift"], ["invalid"], []]
