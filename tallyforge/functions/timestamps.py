"""Timestamps in mixed spellings, precisions and zones, normalised to one UTC instant or day.

Method: every text is split by one regular expression into its written parts (JVM-side, one pass), which give a local
wall-clock time. Local times without a zone are looked up as-of in a table of zone-offset intervals in local time,
exploded onto calendar months so that the lookup is an equality join on (zone, month): two matching intervals mean an
ambiguous time (``fold``), none a skipped one (``gap``), one gives the offset directly.

The exploded table has zones x months rows (a few hundred for the zones of a feed table and a span of years). Its size is
known when it is built, so the broadcast is checked; beyond ``BROADCAST_ROWS`` the join shuffles instead.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.values import is_missing, strip
from tallyforge.session import broadcast_within

#: Feed descriptions collected to the driver; a larger feed table is refused.
MAX_FEEDS = 10_000
#: Broadcast limit for the exploded interval table, in rows.
BROADCAST_ROWS = 200_000

SECOND, DAY = 1_000_000, 86_400_000_000
SEP = "\u0001"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
#: Further spellings of month names (upper case, first letters that tell them apart).
MONTH_ALIASES = {"MÄR": 3, "MAI": 5, "OKT": 10, "DEZ": 12}

# groups: 1-3 y m d | 4-6 a/b/y | 7-9 d.m.y | 10-12 d mon y | 13-15 mon d y | 16-18 yyyymmdd | 19-22 time | 23 am/pm | 24 zone | 25 [area]
PATTERN = (
    r"^(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*\.?,?\s+)?"
    r"(?:(\d{4})[-/](\d{1,2})[-/](\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4})|(\d{1,2})\.(\d{1,2})\.(\d{4})"
    r"|(\d{1,2})[-\s]([A-ZÄ]{3,9})\.?,?[-\s](\d{4})|([A-ZÄ]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})|(\d{4})(\d{2})(\d{2}))"
    r"(?:(?:\s*T\s*|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AP])\.?M\.?)?"
    r"(?:\s*(Z|[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?))?(?:\s*\[([A-Z0-9_+\-/]+)\])?)?$"
)


def zone_intervals(zones: list[str], first_year: int, last_year: int) -> tuple[list[tuple], list[tuple]]:
    """Offset intervals in local time, exploded onto months: (zone, month, [(start, end, offset)]), and (zone, abbreviation, offset).

    Times are microseconds since 1970 on the local clock; month is year * 12 + month - 1.
    """
    start, end = datetime(first_year - 1, 12, 1, tzinfo=UTC), datetime(last_year + 1, 2, 1, tzinfo=UTC)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    exploded, names = [], set()
    for zone in sorted(set(zones)):
        info = ZoneInfo(zone)
        at = lambda t, info=info: int(t.astimezone(info).utcoffset().total_seconds())
        spans, t, since = [], start, start
        while t < end:  # offsets change at most once in a few days; a change is then found by halving
            step = min(t + timedelta(days=3), end)
            if at(step) != at(t):
                lo, hi = t, step
                while hi - lo > timedelta(seconds=1):
                    mid = lo + (hi - lo) // 2
                    lo, hi = (lo, mid) if at(mid) != at(t) else (mid, hi)
                change = hi.replace(microsecond=0)
                spans.append((since, change, at(t)))
                since = change
            t = step
        spans.append((since, end, at(end)))
        local = [(int((a - epoch).total_seconds() + off) * SECOND, int((b - epoch).total_seconds() + off) * SECOND, off) for a, b, off in spans]
        for a, _b, off in spans:
            names.add((zone, a.astimezone(info).tzname().upper(), off))
        for month in range(first_year * 12 - 1, last_year * 12 + 13):
            lo = int((datetime(month // 12, month % 12 + 1, 1, tzinfo=UTC) - epoch).total_seconds()) * SECOND
            near = [x for x in local if x[0] < lo + 34 * DAY and x[1] > lo - 3 * DAY]
            exploded.append((zone, month, near))
    return exploded, [x for x in sorted(names) if x[1].isalpha()]


def zone_exists(zone: str | None) -> bool:
    try:
        return bool(zone) and ZoneInfo(zone) is not None
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return False


class TimestampParser:
    """Parses text columns of tables that name a feed.

    ``feeds`` has the columns feed, time_zone, day_first and null_token and stays small (at most MAX_FEEDS rows).
    ``years`` is the span of real dates; a date outside it counts as no real date.
    """

    def __init__(self, spark: SparkSession, feeds: DataFrame, years: tuple[int, int] = (1970, 2100)):
        rows = feeds.select("feed", "time_zone", "day_first", "null_token").limit(MAX_FEEDS + 1).collect()
        if len(rows) > MAX_FEEDS:
            raise ValueError(f"more than {MAX_FEEDS} feeds")
        self.years = years
        # a feed given twice counts once; a zone that doesn't exist is an unknown one
        rows = list({r.feed: r for r in sorted(rows, key=str) if r.feed is not None}.values())
        exploded, names = zone_intervals([r.time_zone for r in rows if zone_exists(r.time_zone)], *years)
        abbreviations: dict[str, list] = {}
        for zone, name, offset in names:
            abbreviations.setdefault(zone, []).append((name, offset))
        self.feeds = broadcast_within(
            spark.createDataFrame(
                [(r.feed, r.time_zone, r.day_first, r.null_token, abbreviations.get(r.time_zone, [])) for r in rows],
                "_feed string, _zone string, _day_first boolean, _token string, _names array<struct<name: string, off: int>>",
            ), len(rows), MAX_FEEDS,
        )
        self.intervals = broadcast_within(
            spark.createDataFrame(exploded, "_izone string, _imonth int, _spans array<struct<s: bigint, e: bigint, off: int>>"),
            len(exploded), BROADCAST_ROWS,
        )

    def with_feed(self, df: DataFrame, feed: str = "feed") -> DataFrame:
        """Adds _zone, _day_first, _token and _names of each row's feed (null where the feed is null or unknown)."""
        return df.join(self.feeds, df[feed] == self.feeds["_feed"], "left").drop("_feed")

    def parse(self, df: DataFrame, text: str, feed: str = "feed", out: str = "ts") -> DataFrame:
        """Adds the column ``out``, a struct of status, kind, issue, utc_us, utc, utc_day, written_day and day_shift.

        status: ``missing``, ``invalid`` (not missing and no real date or time), ``unresolved`` (a real wall-clock time whose
        zone or day order is unknown because the feed is) or ``ok``. kind: ``date`` (no time: the day itself), ``epoch``,
        ``zoned`` (zone or offset in the text) or ``local``. issue: ``gap`` or ``fold`` of local times; a skipped time is read
        with the offset before the change, a repeated one as its first occurrence. Works on null, empty and very long
        texts; all columns of ``df`` are kept, whatever their names, but for one that is called ``out``, which is replaced.
        """
        lo_year, hi_year = self.years
        keep = [c for c in df.columns if c != out]
        df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{feed}`").alias("_of"))
        df = self.with_feed(df, "_of")
        raw = F.upper(strip(F.col("_text")))
        df = df.withColumn("_missing", is_missing(F.col("_text"), F.col("_token"))).withColumn("_t", F.when(~F.col("_missing"), raw))
        parts = F.split(F.regexp_replace("_t", PATTERN, SEP + SEP.join(f"${i}" for i in range(1, 26))), SEP)
        df = df.withColumn("_p", F.when(~F.contains("_t", F.lit(SEP)), parts)).withColumn("_match", F.size("_p") == 26)
        g = lambda i: F.when(F.col("_match"), F.nullif(F.get("_p", F.lit(i)), F.lit("")))
        num = lambda i: g(i).try_cast("int")
        a, b = num(4), num(5)
        day_first = F.coalesce(F.col("_day_first"), F.when(a > 12, True).when(b > 12, False))
        name = F.substring(F.coalesce(g(11), g(13)), 1, 3)
        month_of = F.create_map(*[x for m, n in [*((m, i + 1) for i, m in enumerate(MONTHS)), *MONTH_ALIASES.items()] for x in (F.lit(m), F.lit(n))])
        named = F.try_element_at(month_of, name)
        order_unknown = F.col("_match") & a.isNotNull() & day_first.isNull()
        year = F.coalesce(num(1), num(6), num(9), num(12), num(15), num(16))
        month = F.coalesce(num(2), F.when(day_first, b).otherwise(a), num(8), named, num(17))
        day = F.coalesce(num(3), F.when(day_first, a).otherwise(b), num(7), num(10), num(14), num(18))
        zero = F.lit(0)
        written = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)")).cast("date")
        half = g(23)
        hour_text = num(19)
        hour = F.when(half.isNull(), hour_text).when(hour_text.between(1, 12), hour_text % 12 + F.when(half == "P", 12).otherwise(0))
        second = F.coalesce(num(21), zero)
        micros = F.coalesce(F.substring(F.rpad(g(22), 9, "0"), 1, 6).try_cast("bigint"), F.lit(0).cast("bigint"))
        has_time = hour_text.isNotNull()
        time_ok = ~has_time | (hour.between(0, 23) & (num(20) < 60) & (second < 60))
        zone = g(24)
        sign = F.when(zone.startswith("-"), -1).otherwise(1)
        digits = F.regexp_replace(zone, "[^0-9]", "")
        oh, om = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), zero)
        numeric = F.when(zone.rlike(r"^[+-]") & (oh <= 18) & (om < 60), sign * (oh * 3600 + om * 60))
        named_off = F.get(F.filter("_names", lambda x: x["name"] == zone), zero)["off"]
        offset = F.when(zone.isin("Z", "UTC", "GMT", "UT"), 0).when(zone.rlike(r"^[+-]"), numeric).otherwise(named_off)
        digits_only = F.when(F.col("_t").rlike(r"^(\d{10}|\d{13})$"), F.col("_t").try_cast("bigint"))
        epoch_us = F.when(F.length("_t") == 13, digits_only * 1000).otherwise(digits_only * SECOND)
        origin = F.lit("1970-01-01").cast("date")
        df = (
            df.withColumn("_date", F.when(year.between(lo_year, hi_year) & ~order_unknown, written))
            .withColumn("_unknown_order", F.coalesce(order_unknown, F.lit(False)))
            .withColumn("_has_time", F.coalesce(has_time, F.lit(False)))
            .withColumn("_zone_text", zone).withColumn("_area", F.lower(g(25))).withColumn("_offset", offset)
            .withColumn("_epoch_us", F.when(F.year(F.timestamp_micros(epoch_us)).between(lo_year, hi_year), epoch_us))
            .withColumn("_local_us", F.when(F.coalesce(time_ok, F.lit(False)), F.datediff("_date", origin).cast("bigint") * DAY + F.when(F.col("_has_time"), (hour * 3600 + num(20) * 60 + second).cast("bigint") * SECOND + micros).otherwise(F.lit(0).cast("bigint"))))
        )
        # an area without an offset names the zone itself; only zones of the feed table are known here
        needs_zone = F.col("_has_time") & F.col("_zone_text").isNull()
        df = df.withColumn("_lookup_month", F.when(needs_zone, F.year("_date") * 12 + F.month("_date") - 1))
        joined = df.join(self.intervals, (df["_zone"] == self.intervals["_izone"]) & (df["_lookup_month"] == self.intervals["_imonth"]), "left")
        local = F.col("_local_us")
        joined = joined.withColumn("_hits", F.filter("_spans", lambda x: (x["s"] <= local) & (local < x["e"])))
        before = F.element_at(F.filter("_spans", lambda x: x["e"] <= local), -1)["off"]
        same_area = F.col("_area").isNull() | (F.col("_area") == F.lower("_zone"))
        looked_up = F.when(F.size("_hits") > 0, F.col("_hits")[0]["off"]).when(F.size("_hits") == 0, before)
        final_offset = F.when(F.col("_zone_text").isNotNull(), F.col("_offset")).when(same_area, looked_up)
        kind = (
            F.when(F.col("_epoch_us").isNotNull(), "epoch").when(~F.col("_has_time"), "date")
            .when(F.col("_zone_text").isNotNull() | F.col("_area").isNotNull(), "zoned").otherwise("local")
        )
        joined = joined.withColumn("_kind", kind).withColumn(
            "_utc_us",
            F.when(F.col("_kind") == "epoch", F.col("_epoch_us")).when(F.col("_kind") == "date", local).otherwise(local - final_offset.cast("bigint") * SECOND),
        )
        no_zone = F.col("_has_time") & local.isNotNull() & F.col("_zone_text").isNull() & F.col("_utc_us").isNull()
        status = (
            F.when(F.col("_missing"), "missing").when(F.col("_utc_us").isNotNull(), "ok")
            .when(F.col("_unknown_order") | no_zone, "unresolved").otherwise("invalid")
        )
        ok = F.col("_utc_us").isNotNull() & ~F.col("_missing")
        utc_day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_utc_us") / DAY).cast("int"))
        issue = F.when(ok & (F.col("_kind") == "local") & (F.size("_hits") == 0), "gap").when(ok & (F.col("_kind") == "local") & (F.size("_hits") == 2), "fold")
        result = F.struct(
            status.alias("status"),
            F.when(ok, F.col("_kind")).alias("kind"),
            issue.alias("issue"),
            F.when(ok, F.col("_utc_us")).alias("utc_us"),
            F.when(ok, F.timestamp_micros("_utc_us")).alias("utc"),
            F.when(ok, utc_day).alias("utc_day"),
            F.when(ok, F.col("_date")).alias("written_day"),
            F.coalesce(ok & F.col("_kind").isin("zoned", "local") & (utc_day != F.col("_date")), F.lit(False)).alias("day_shift"),
        )
        return joined.select(*[F.col("_row").getField(c).alias(c) for c in keep], result.alias(out))


def issues(ts: str) -> Column:
    """Array of the issue names of a parsed struct: invalid, gap or fold, day_shift."""
    t = F.col(ts)
    return F.array_compact(F.array(F.when(t["status"] == "invalid", "invalid"), t["issue"], F.when(t["day_shift"], "day_shift")))
