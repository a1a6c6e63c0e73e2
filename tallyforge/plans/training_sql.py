"""SQL of those pN queries that SQL can express over whole tables."""

from __future__ import annotations

from tallyforge.functions.timestamps import DAY, MONTH_ALIASES, MONTHS, PATTERN, zone_intervals
from tallyforge.functions.values import MISSING_WORDS

#: Zones of the feed table, for the interval table written into the SQL (SQL without time zone data can't make it).
ZONES = ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney", "UTC", "America/Sao_Paulo", "Europe/London", "America/Chicago"]
YEARS = (2021, 2025)

_QUOTED = ["'" + w.replace("'", "''") + "'" for w in MISSING_WORDS]
_WORDS, _WORDS_FOR_NUMBERS = ", ".join(_QUOTED), ", ".join(w for w in _QUOTED if w != "'nan'")


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}\\x{{200B}}\\x{{FEFF}}]+|[\\s\\p{{Z}}\\x{{200B}}\\x{{FEFF}}]+$', '', 'g')"


def missing(c: str, token: str, numeric: bool = False) -> str:
    t, words = strip(c), _WORDS_FOR_NUMBERS if numeric else _WORDS
    return f"({c} IS NULL OR {t} = '' OR lower({t}) IN ({words}) OR regexp_full_match({t}, '[-–—?.…_*]+') OR COALESCE({t} = {strip(token)}, false))"


def number(c: str) -> str:
    t = strip(f"regexp_replace({c}, '[\\p{{Sc}},%]', '', 'g')")
    return f"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST({t} AS DOUBLE)) THEN TRY_CAST({t} AS DOUBLE) END"


def _interval_rows() -> tuple[str, str]:
    exploded, names = zone_intervals(ZONES, *YEARS)
    spans = sorted({(zone, a, b, off) for zone, _, near in exploded for a, b, off in near})
    return ", ".join(f"('{z}', {a}, {b}, {off})" for z, a, b, off in spans), ", ".join(f"('{z}', '{n}', {off})" for z, n, off in names)


_SPANS, _NAMES = _interval_rows()
_GROUPS = ", ".join(f"'a{i}'" for i in range(1, 26))
_MONTH_CASE = "CASE substr(coalesce(nullif(g.a11, ''), g.a13), 1, 3) " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in [*((m, i + 1) for i, m in enumerate(MONTHS)), *MONTH_ALIASES.items()]) + " END"


def _int(i: int) -> str:
    return f"TRY_CAST(nullif(g.a{i}, '') AS INTEGER)"


def dates(source: str) -> str:
    """CTEs that end in ``stamped`` (k, status, kind, issue, utc_us, utc_day, day_shift, text) from ``source``, a query of (k, text, feed)."""
    offset = (
        f"CASE WHEN g.a24 IN ('Z', 'UTC', 'GMT', 'UT') THEN 0 WHEN regexp_matches(g.a24, '^[+-]') THEN CASE WHEN TRY_CAST(substr(zd, 1, 2) AS INTEGER) <= 18 AND COALESCE(TRY_CAST(nullif(substr(zd, 3, 2), '') AS INTEGER), 0) < 60 "
        f"THEN (CASE WHEN g.a24 LIKE '-%' THEN -1 ELSE 1 END) * (TRY_CAST(substr(zd, 1, 2) AS INTEGER) * 3600 + COALESCE(TRY_CAST(nullif(substr(zd, 3, 2), '') AS INTEGER), 0) * 60) END "
        f"ELSE (SELECT MIN(off) FROM abbreviations x WHERE x.zone = time_zone AND x.name = g.a24) END"
    )
    return f"""
spans(zone, s, e, off) AS (VALUES {_SPANS}), abbreviations(zone, name, off) AS (VALUES {_NAMES}),
src AS ({source}),
trimmed AS (SELECT k, text, time_zone, day_first, {missing('text', 'null_token')} AS gone, upper({strip('text')}) AS t FROM src LEFT JOIN feeds ON src.feed = feeds.feed),
split AS (SELECT *, CASE WHEN NOT gone THEN regexp_extract(t, '{PATTERN.replace("'", "''")}', [{_GROUPS}]) END AS g, CASE WHEN NOT gone AND regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}') THEN CAST(t AS BIGINT) * CASE WHEN length(t) = 13 THEN 1000 ELSE 1000000 END END AS eus FROM trimmed),
digits AS (SELECT *, COALESCE({_int(1)}, {_int(6)}, {_int(9)}, {_int(12)}, {_int(15)}, {_int(16)}) AS y, COALESCE({_int(2)}, CASE WHEN day_first THEN {_int(5)} ELSE {_int(4)} END, {_int(8)}, {_MONTH_CASE}, {_int(17)}) AS m,
    COALESCE({_int(3)}, CASE WHEN day_first THEN {_int(4)} ELSE {_int(5)} END, {_int(7)}, {_int(10)}, {_int(14)}, {_int(18)}) AS d, COALESCE(g.a19, '') <> '' AS timed,
    CASE WHEN g.a23 = '' THEN {_int(19)} WHEN {_int(19)} BETWEEN 1 AND 12 THEN {_int(19)} % 12 + CASE WHEN g.a23 = 'P' THEN 12 ELSE 0 END END AS hh, {_int(20)} AS mi, COALESCE({_int(21)}, 0) AS ss,
    COALESCE(TRY_CAST(substr(rpad(nullif(g.a22, ''), 9, '0'), 1, 6) AS BIGINT), 0) AS us, regexp_replace(g.a24, '[^0-9]', '', 'g') AS zd FROM split),
dated AS (SELECT *, CASE WHEN y BETWEEN {YEARS[0]} AND {YEARS[1]} THEN TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS day FROM digits),
local AS (SELECT *, CASE WHEN NOT timed OR (hh BETWEEN 0 AND 23 AND mi < 60 AND ss < 60) THEN CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) * {DAY} + CASE WHEN timed THEN CAST(hh * 3600 + mi * 60 + ss AS BIGINT) * 1000000 + us ELSE 0 END END AS l,
    CASE WHEN year(make_timestamp(eus)) BETWEEN {YEARS[0]} AND {YEARS[1]} THEN eus END AS epoch, {offset} AS toff FROM dated),
looked AS (SELECT *, (SELECT COUNT(*) FROM spans WHERE zone = time_zone AND s <= l AND l < e) AS hits, (SELECT FIRST(off ORDER BY s) FROM spans WHERE zone = time_zone AND s <= l AND l < e) AS hit, (SELECT LAST(off ORDER BY e) FROM spans WHERE zone = time_zone AND e <= l) AS before FROM local),
solved AS (SELECT *, CASE WHEN epoch IS NOT NULL THEN 'epoch' WHEN NOT timed OR timed IS NULL THEN 'date' WHEN g.a24 <> '' OR g.a25 <> '' THEN 'zoned' ELSE 'local' END AS knd, CASE WHEN epoch IS NOT NULL THEN epoch WHEN NOT timed THEN l WHEN g.a24 <> '' THEN l - CAST(toff AS BIGINT) * 1000000 ELSE l - CAST(COALESCE(hit, before) AS BIGINT) * 1000000 END AS u FROM looked),
stamped AS (SELECT k, text, CASE WHEN gone THEN 'missing' WHEN u IS NOT NULL THEN 'ok' ELSE 'invalid' END AS status, CASE WHEN u IS NOT NULL THEN knd END AS kind, CASE WHEN u IS NOT NULL AND knd = 'local' THEN CASE hits WHEN 0 THEN 'gap' WHEN 2 THEN 'fold' END END AS issue, u AS utc_us,
    strftime(make_timestamp(u), '%Y-%m-%d') AS utc_day, COALESCE(knd IN ('local', 'zoned') AND CAST(make_timestamp(u) AS DATE) <> day, false) AS day_shift FROM solved)"""


_DATED = " UNION ALL ".join(f"SELECT {{'t': '{t}', 'r': row_id}} AS k, {c} AS text, feed FROM {t}" for t, c in (("finance", "date"), ("messy", "order_date"), ("customer_profile", "signup_date")))
_P2 = f"WITH {dates(_DATED)}"
_P1 = f"""
WITH {dates("SELECT {'e': entry_id, 'a': account, 'c': CAST(ROUND(CASE WHEN isfinite(revenue) THEN revenue ELSE 0 END * 100) AS BIGINT)} AS k, date AS text, feed FROM finance")},
once AS (SELECT k.e AS e, MIN(k.a) AS account, MIN(CAST(utc_day AS DATE)) AS day, MIN(k.c) AS cents FROM stamped WHERE status = 'ok' GROUP BY 1),
daily AS (SELECT account, day, CAST(SUM(cents) AS BIGINT) AS cents, COUNT(*) AS n FROM once GROUP BY 1, 2),
bounds AS (SELECT account, MIN(day) AS a, MAX(day) AS b FROM daily GROUP BY 1),
calendar AS (SELECT account, a, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds),
every AS (SELECT c.account, c.a, c.day, COALESCE(cents, 0) AS cents, COALESCE(n, 0) AS n FROM calendar c LEFT JOIN daily d ON c.account = d.account AND c.day = d.day),
rolled AS (SELECT account, a, day, n, CAST(SUM(cents) OVER (PARTITION BY account ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS c7, CAST(SUM(cents) OVER (PARTITION BY account ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS c30 FROM every)
"""
_F = '("(?:[^"]|"")*"|[^",]*)'


def _unquoted(i: int) -> str:
    return f"CASE WHEN f.f{i} LIKE '\"%' THEN replace(substr(f.f{i}, 2, length(f.f{i}) - 2), '\"\"', '\"') ELSE f.f{i} END"


_P3 = f"""
WITH raw AS (SELECT raw_id, feed, regexp_replace(raw_line, '\\r$', '') AS line FROM messy_raw),
shaped AS (SELECT *, regexp_full_match(line, '(?s){_F}(?:,{_F})*') AS sound, regexp_replace(line, '"(?:[^"]|"")*"', '', 'g') AS bare FROM raw),
judged AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN length(bare) - length(replace(bare, ',', '')) <> 4 OR contains(bare, chr(10)) OR contains(bare, chr(13)) THEN 'column_count' END AS reason FROM shaped),
fields AS (SELECT raw_id, feed, regexp_extract(line, '(?s)^{_F},{_F},{_F},{_F},{_F}$', ['f1', 'f2', 'f3', 'f4', 'f5']) AS f FROM judged WHERE reason IS NULL),
cells AS (SELECT raw_id, fields.feed AS feed, null_token, {_unquoted(1)} AS order_id, {_unquoted(2)} AS order_date, {_unquoted(3)} AS category, {_unquoted(4)} AS revenue, {_unquoted(5)} AS is_active FROM fields LEFT JOIN feeds ON fields.feed = feeds.feed),
{dates("SELECT raw_id AS k, order_date AS text, feed FROM cells")}
"""
_P3_FOUND = f"""
SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT raw_id, 'order_id' FROM cells WHERE NOT {missing('order_id', 'null_token', True)} AND NOT regexp_full_match({strip('order_id')}, '[+-]?[0-9]+(\\.0*)?')
UNION ALL SELECT raw_id, 'revenue' FROM cells WHERE NOT {missing('revenue', 'null_token', True)} AND {number('revenue')} IS NULL
UNION ALL SELECT k, 'order_date' FROM stamped WHERE status = 'invalid'
"""


def _known(c: str, numeric: bool = False) -> str:
    return f"CASE WHEN NOT {missing(c, 'null_token', numeric)} THEN {strip(c)} END"


_P3_LOADED = f"""
, bad AS ({_P3_FOUND})
SELECT cells.raw_id, TRY_CAST(regexp_replace({_known('order_id')}, '\\.0*$', '') AS BIGINT) AS order_id, stamped.utc_us AS order_utc_micros, {_known('category')} AS category,
       {number(_known('revenue'))} AS revenue, {_known('is_active')} AS is_active
FROM cells LEFT JOIN stamped ON stamped.k = cells.raw_id WHERE cells.raw_id NOT IN (SELECT raw_id FROM bad)
"""

_P5 = f"""
WITH c AS (SELECT m.row_id, {strip('m.product_id')} AS product, CASE WHEN NOT {missing('m.category', 'f.null_token')} THEN {strip('m.category')} END AS category,
                  CASE WHEN NOT {missing('m.revenue', 'f.null_token')} THEN {number('m.revenue')} END AS revenue
           FROM messy m LEFT JOIN feeds f ON m.feed = f.feed),
p AS (SELECT product, COUNT(category) AS categories, COUNT(revenue) AS revenues FROM c WHERE product IS NOT NULL GROUP BY 1)
SELECT row_id, 'category' AS column_name FROM c JOIN p USING (product) WHERE category IS NULL AND categories > 0
UNION ALL SELECT row_id, 'revenue' FROM c JOIN p USING (product) WHERE revenue IS NULL AND revenues > 0
"""



def _near(c: str, way: str) -> str:
    rows = "UNBOUNDED PRECEDING AND CURRENT ROW" if way == "LAST" else "CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"{way}_VALUE(CASE WHEN {c} IS NOT NULL THEN {{'s': s, 'v': {c}}} END IGNORE NULLS) OVER (PARTITION BY product ORDER BY s, row_id ROWS BETWEEN {rows})"


_LIMIT = 30 * 86_400
_P5_FILLED = f"""
WITH c AS (SELECT m.row_id, m.product_id, {strip('m.product_id')} AS product, epoch_us(m.received_at) / 1e6 AS s, {missing('m.category', 'f.null_token')} AS no_category,
             CASE WHEN NOT {missing('m.category', 'f.null_token')} THEN {strip('m.category')} END AS category, CASE WHEN NOT {missing('m.revenue', 'f.null_token')} THEN {number('m.revenue')} END AS revenue
           FROM messy m LEFT JOIN feeds f ON m.feed = f.feed),
w AS (SELECT *, {_near('category', 'LAST')} AS pc, {_near('category', 'FIRST')} AS nc, {_near('revenue', 'LAST')} AS pr, {_near('revenue', 'FIRST')} AS nr FROM c),
often AS (SELECT product, category AS top FROM (SELECT product, category, ROW_NUMBER() OVER (PARTITION BY product ORDER BY COUNT(*) DESC, category) AS k FROM c WHERE category IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
means AS (SELECT product, AVG(revenue) AS mean FROM c GROUP BY 1),
d AS (SELECT w.*, top, mean, no_category AND w.product IS NOT NULL AND (pc IS NOT NULL OR nc IS NOT NULL) AS fc, revenue IS NULL AND w.product IS NOT NULL AND (pr IS NOT NULL OR nr IS NOT NULL) AS fr,
        s - pc.s AS bc, nc.s - s AS ac, s - pr.s AS br, nr.s - s AS ar FROM w LEFT JOIN often ON w.product = often.product LEFT JOIN means ON w.product = means.product),
e AS (SELECT *, LEAST(bc, ac) AS dc, LEAST(br, ar) AS dr FROM d)
SELECT row_id, product_id, CASE WHEN fc THEN CASE WHEN dc <= {_LIMIT} THEN CASE WHEN nc IS NULL OR bc <= ac THEN pc.v ELSE nc.v END ELSE top END ELSE category END AS category_value, fc AS category_filled,
  CASE WHEN fc THEN CASE WHEN dc <= {_LIMIT} THEN 'carried' ELSE 'frequent' END END AS category_method, CASE WHEN fc THEN ROUND(dc, 3) END AS category_distance,
  CASE WHEN fr THEN ROUND(CASE WHEN pr IS NOT NULL AND nr IS NOT NULL THEN CASE WHEN nr.s > pr.s THEN pr.v + (nr.v - pr.v) * (br / (nr.s - pr.s)) ELSE (pr.v + nr.v) / 2 END WHEN dr <= {_LIMIT} THEN COALESCE(pr.v, nr.v) ELSE mean END, 4) ELSE ROUND(revenue, 4) END AS revenue_value, fr AS revenue_filled,
  CASE WHEN fr THEN CASE WHEN pr IS NOT NULL AND nr IS NOT NULL THEN 'interpolated' WHEN dr <= {_LIMIT} THEN 'carried' ELSE 'average' END END AS revenue_method, CASE WHEN fr THEN ROUND(dr, 3) END AS revenue_distance
FROM e
"""
_NUMERIC = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END AS v FROM ecommerce" for c in ("revenue", "quantity", "profit"))
_P4 = f"""
WITH v AS ({_NUMERIC}),
b AS (SELECT * FROM column_baseline WHERE table_name = 'ecommerce'),
k AS (SELECT load_id, column_name, v, COUNT(*) AS n FROM v GROUP BY ALL),
a AS (SELECT 'ecommerce' AS table_name, k.column_name, CAST(load_id AS BIGINT) AS load_id, CAST(SUM(n) AS BIGINT) AS rows, CAST(COALESCE(SUM(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS nulls, COUNT(v) AS distinct_values,
        MIN(v) AS min_value, MAX(v) AS max_value, CAST(COALESCE(SUM(n) FILTER (WHERE v < value_min OR v > value_max), 0) AS BIGINT) AS strays, COALESCE(MAX(n) FILTER (WHERE v IS NOT NULL), 0) AS top_count,
        COALESCE(SUM(n) FILTER (WHERE v <= q25), 0) AS n1, COALESCE(SUM(n) FILTER (WHERE v > q25 AND v <= q50), 0) AS n2, COALESCE(SUM(n) FILTER (WHERE v > q50 AND v <= q75), 0) AS n3, COALESCE(SUM(n) FILTER (WHERE v > q75), 0) AS n4
      FROM k JOIN b ON k.column_name = b.column_name GROUP BY ALL),
x AS (SELECT load_id, CASE WHEN {strip('is_active')} <> '' THEN is_active END AS v FROM messy),
xk AS (SELECT load_id, v, COUNT(*) AS n FROM x GROUP BY ALL),
t AS (SELECT 'messy' AS table_name, 'is_active' AS column_name, CAST(load_id AS BIGINT) AS load_id, CAST(SUM(n) AS BIGINT) AS rows, CAST(COALESCE(SUM(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS nulls, COUNT(v) AS distinct_values,
        CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value,
        CAST(COALESCE(SUM(n) FILTER (WHERE v IS NOT NULL AND NOT list_contains(string_split((SELECT accepted FROM column_baseline WHERE table_name = 'messy' AND column_name = 'is_active'), '|'), v)), 0) AS BIGINT) AS strays,
        COALESCE(MAX(n) FILTER (WHERE v IS NOT NULL), 0) AS top_count FROM xk GROUP BY load_id)
"""
_SHARE = "(rows - nulls)"
_LIMITS = "JOIN column_baseline c ON c.table_name = {0}.table_name AND c.column_name = {0}.column_name"

ORACLE_SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT account, strftime(day, '%Y-%m-%d') AS day_utc FROM rolled WHERE c30 > 0 AND c7 * 30 > c30 * 21 AND day >= a + INTERVAL 29 DAY",
    "p1_rolling_totals": _P1 + "SELECT account, strftime(day, '%Y-%m-%d') AS day_utc, n AS entries, c7 / 100 AS total_revenue_7, c30 / 100 AS total_revenue_30, ROUND(c7 / 7e0 / 100, 4) AS average_revenue_7, ROUND(c30 / 30e0 / 100, 4) AS average_revenue_30 FROM rolled",
    "p2_found": _P2 + " SELECT k.t AS table_name, k.r AS row_id, 'invalid' AS issue FROM stamped WHERE status = 'invalid' UNION ALL SELECT k.t, k.r, issue FROM stamped WHERE issue IS NOT NULL UNION ALL SELECT k.t, k.r, 'day_shift' FROM stamped WHERE day_shift",
    "p2_normalised": _P2 + " SELECT k.t AS table_name, k.r AS row_id, text, status, kind, issue AS clock_issue, day_shift, utc_us AS utc_micros, utc_day FROM stamped",
    "p3_found": _P3 + _P3_FOUND,
    "p3_loaded": _P3 + _P3_LOADED,
    "p4_base_aggregates": _P4 + "SELECT table_name, column_name, load_id, rows, nulls, distinct_values, min_value, max_value, strays, top_count FROM a UNION ALL SELECT * FROM t",
    "p4_found": _P4 + f"""
SELECT a.table_name, a.column_name, load_id, 'null_rate' AS issue FROM a {_LIMITS.format('a')} WHERE nulls / rows > null_limit
UNION ALL SELECT t.table_name, t.column_name, load_id, 'null_rate' FROM t {_LIMITS.format('t')} WHERE nulls / rows > null_limit
UNION ALL SELECT a.table_name, a.column_name, load_id, 'range' FROM a {_LIMITS.format('a')} WHERE rows > nulls AND strays / {_SHARE} > stray_limit
UNION ALL SELECT t.table_name, t.column_name, load_id, 'pattern' FROM t {_LIMITS.format('t')} WHERE rows > nulls AND strays / {_SHARE} > stray_limit
UNION ALL SELECT table_name, column_name, load_id, 'stuck' FROM a WHERE rows > nulls AND top_count / {_SHARE} > 0.5
UNION ALL SELECT a.table_name, a.column_name, load_id, 'distribution' FROM a {_LIMITS.format('a')} WHERE rows > nulls
  AND (ABS(n1 / {_SHARE} - band1) > band_limit OR ABS(n2 / {_SHARE} - band2) > band_limit OR ABS(n3 / {_SHARE} - band3) > band_limit OR ABS(n4 / {_SHARE} - band4) > band_limit)
""",
    "p4_band_shares": _P4 + f"SELECT table_name, column_name, load_id, ROUND(nulls / rows, 6) AS null_rate, ROUND(strays / NULLIF({_SHARE}, 0), 6) AS stray_share, " + ", ".join(f"ROUND(n{i} / NULLIF({_SHARE}, 0), 6) AS band{i}_share" for i in range(1, 5)) + " FROM a",
    "p5_found": _P5,
    "p5_filled": _P5_FILLED,
}
