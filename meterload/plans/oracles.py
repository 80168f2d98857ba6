"""Independent SQL for the query catalogue, in the dialect of a single-node SQL engine.

Written from the definitions, not from the Spark plans: joins with a spine, correlated window
frames and long rows where the jobs use grouped unions and arrays.
"""

from __future__ import annotations

SENSORS = ("air1", "kitchen1", "car1", "solar")

# Hourly meters of all active users, gaps exposed and filled.
HOURLY = """
hourly AS (
  SELECT user_id AS dataid,
         CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) + 1 AS INTEGER) AS idx,
         sum(value) FILTER (WHERE event_type = 'view') AS air1,
         sum(value) FILTER (WHERE event_type = 'click') AS kitchen1,
         sum(value) FILTER (WHERE event_type = 'signup') AS car1,
         sum(value) FILTER (WHERE event_type = 'purchase') AS solar,
         sum(value) FILTER (WHERE event_type = 'error') AS grid
  FROM events GROUP BY 1, 2),
spine AS (SELECT CAST(i AS INTEGER) AS idx, TIMESTAMP '2024-01-01' + to_hours(i - 1) AS ts FROM range(1, 721) t(i)),
gaps AS (
  SELECT u.dataid, s.idx, h.air1, h.kitchen1, h.car1, h.solar
  FROM (SELECT DISTINCT user_id AS dataid FROM events) u CROSS JOIN spine s
  LEFT JOIN hourly h ON h.dataid = u.dataid AND h.idx = s.idx),
filled AS (
  SELECT dataid, idx,
         coalesce(last_value(air1 IGNORE NULLS) OVER w, 0) AS air1,
         coalesce(last_value(kitchen1 IGNORE NULLS) OVER w, 0) AS kitchen1,
         coalesce(last_value(car1 IGNORE NULLS) OVER w, 0) AS car1,
         coalesce(last_value(solar IGNORE NULLS) OVER w, 0) AS solar
  FROM gaps WINDOW w AS (PARTITION BY dataid ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""

HOMES = """
homes AS (
  SELECT DISTINCT e.user_id AS dataid, r.r_name AS city, n.n_name AS state
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
placed AS (
  SELECT dataid, city, state, CAST(community AS INTEGER) AS community FROM (
    SELECT *, dense_rank() OVER (ORDER BY city, rn // 5) AS community FROM (
      SELECT *, row_number() OVER (PARTITION BY city ORDER BY dataid) - 1 AS rn FROM homes))
  QUALIFY count(*) OVER (PARTITION BY community) = 5)"""

PRESENT = """
present AS (
  SELECT DISTINCT p.city, p.community, p.dataid,
         CASE e.event_type WHEN 'view' THEN 'air1' WHEN 'click' THEN 'kitchen1'
              WHEN 'signup' THEN 'car1' WHEN 'purchase' THEN 'solar' END AS sensor
  FROM placed p JOIN events e ON e.user_id = p.dataid WHERE e.event_type <> 'error')"""

TOTALS = """
household AS (
  SELECT p.city, p.community, f.dataid, f.idx, f.air1 + f.kitchen1 + f.car1 - f.solar AS total
  FROM filled f JOIN placed p ON p.dataid = f.dataid),
community AS (SELECT city, community, idx, sum(total) AS total FROM household GROUP BY ALL),
city AS (SELECT city, idx, sum(total) AS total FROM household GROUP BY ALL)"""

APPLIANCE = """
appliance AS (
  SELECT f.dataid, u.sensor, f.idx, u.v FROM filled f,
  LATERAL (VALUES ('air1', f.air1), ('kitchen1', f.kitchen1), ('car1', f.car1), ('solar', f.solar)) u(sensor, v)),
owned AS (
  SELECT p.city, p.community, a.dataid, a.sensor, a.idx, a.v AS total
  FROM appliance a JOIN present p ON p.dataid = a.dataid AND p.sensor = a.sensor)"""

# Targets of the test windows 577..637: rows (win, h, idx).
TARGETS = """
targets AS (
  SELECT CAST(w.i AS INTEGER) AS win, CAST(h.i AS INTEGER) AS h, CAST(w.i + 72 + h.i AS INTEGER) AS idx
  FROM range(577, 638) w(i), range(0, 12) h(i))"""

BASE = ",".join((HOURLY, HOMES, TOTALS))
FULL = ",".join((HOURLY, HOMES, PRESENT, TOTALS, APPLIANCE))

CALENDAR = """
CAST(dayofyear(ts) AS INTEGER) AS dayofyear, CAST(quarter(ts) AS INTEGER) AS season,
CAST(month(ts) AS INTEGER) AS "month", CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
CAST(hour(ts) AS INTEGER) AS hourofday, CAST(minute(ts) AS INTEGER) AS minuteofhour,
CASE WHEN isodow(ts) >= 6 THEN 1 ELSE -1 END AS typeofday"""

def _frames(keys: str) -> str:
    return (f"WINDOW xs AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING), "
            f"ys AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN 72 FOLLOWING AND 83 FOLLOWING)")


KEYS = {
    "appliance": "city, community, dataid, sensor",
    "household": "city, community, dataid",
    "community": "city, community",
    "city": "city",
}
SERIES = {"appliance": "owned", "household": "household", "community": "community", "city": "city"}
LAGS = {"appliance": 24, "household": 48, "community": 72, "city": 12}
LEVELS = ("appliance", "household", "community", "city")


def _same(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))


def _naive(base: str) -> str:
    """CTE `naive`: forecast and actual per entity, window and step of a base level."""
    keys = KEYS[base]
    chosen = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
naive AS (
  SELECT {chosen}, t.win, t.h, a.total AS y, b.total AS y_hat
  FROM targets t JOIN {SERIES[base]} a ON a.idx = t.idx
  JOIN {SERIES[base]} b ON {_same('a', 'b', keys)} AND b.idx = t.idx - {LAGS[base]})"""


def _entity(level: str) -> str:
    return f"concat_ws('/', {KEYS[level]})"


def _level_rows(base: str, level: str) -> str:
    """SELECT of (base_level, level, entity, win, mae, sse) for one aggregation path.

    Forecasts are summed with the generators' sign; actuals come from the level's own totals.
    """
    sign = "CASE WHEN sensor = 'solar' THEN -y_hat ELSE y_hat END" if base == "appliance" else "y_hat"
    if level == base:
        pairs = f"SELECT {KEYS[level]}, win, h, y, y_hat FROM naive"
    else:
        pairs = f"""
          SELECT {', '.join('f.' + k for k in KEYS[level].split(', '))}, f.win, f.h, s.total AS y, f.y_hat FROM (
            SELECT {KEYS[level]}, win, h, sum({sign}) AS y_hat FROM naive GROUP BY ALL) f
          JOIN {SERIES[level]} s ON {_same('f', 's', KEYS[level])} AND s.idx = f.win + 72 + f.h"""
    return f"""
      SELECT '{base}' AS base_level, '{level}' AS level, {_entity(level)} AS entity, win,
             avg(abs(y - y_hat)) AS mae, sum((y - y_hat) * (y - y_hat)) AS sse
      FROM ({pairs}) GROUP BY {KEYS[level]}, win"""


def _drifted(base: str) -> str:
    """CTE `naive` for the user model: mean training output plus the mean of the normalised input."""
    keys = KEYS[base]
    chosen = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
z AS (SELECT {keys}, idx, total, (total - avg(total) OVER ()) / stddev_samp(total) OVER () AS z FROM {SERIES[base]}),
cut AS (SELECT {keys}, idx AS win, avg(z) OVER xs AS x, avg(total) OVER ys AS y FROM z {_frames(keys)}),
drift AS (SELECT {keys}, avg(y) AS m FROM cut WHERE win <= 493 GROUP BY ALL),
naive AS (
  SELECT {chosen}, t.win, t.h, a.total AS y, d.m + c.x AS y_hat
  FROM targets t JOIN {SERIES[base]} a ON a.idx = t.idx JOIN cut c ON {_same('a', 'c', keys)} AND c.win = t.win
  JOIN drift d ON {_same('a', 'd', keys)})"""


# Least squares with two inputs, from the aggregates of m; a column that the other explains, or a constant one, gets 0.
TWO_LAGS = """
b AS (
  SELECT *, CASE WHEN v1 <= 0 THEN 0 ELSE (c1 - b2 * c12) / v1 END AS b1 FROM (
    SELECT *, CASE WHEN p2 > 1e-9 * v2 THEN q2 / p2 ELSE 0 END AS b2 FROM (
      SELECT *, CASE WHEN v1 <= 0 THEN v2 ELSE v2 - c12 * c12 / v1 END AS p2,
             CASE WHEN v1 <= 0 THEN c2 ELSE c2 - c12 * c1 / v1 END AS q2 FROM m)))"""

MOMENTS_2 = """avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
         covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2"""


def _two_lag_forecasts(base: str, by: str) -> str:
    """CTE `naive` for regressions with lags 24 and 48: for all entities (`by` empty) or for each."""
    keys = KEYS[base]
    chosen = ", ".join(f"a.{k}" for k in keys.split(", "))
    group, match = (f"GROUP BY {by}", f"JOIN b ON {_same('a', 'b', by)}") if by else ("", "CROSS JOIN b")
    return f"""
lagged AS MATERIALIZED (
  SELECT {keys}, idx, total AS y, lag(total, 24) OVER w AS x1, lag(total, 48) OVER w AS x2 FROM {SERIES[base]}
  WINDOW w AS (PARTITION BY {keys} ORDER BY idx)),
m AS (SELECT {by + ', ' if by else ''}{MOMENTS_2} FROM lagged WHERE idx BETWEEN 73 AND 576 {group}),
{TWO_LAGS},
naive AS MATERIALIZED (
  SELECT {chosen}, t.win, t.h, a.y, b.my + b.b1 * (a.x1 - b.m1) + b.b2 * (a.x2 - b.m2) AS y_hat
  FROM targets t JOIN lagged a ON a.idx = t.idx {match})"""


# The user model on normalised appliances: z-scores of a sensor over all placed households.
DRIFTED_APPLIANCES = f"""
zs AS (
  SELECT p.city, p.community, a.dataid, a.sensor, a.idx, a.v AS total,
         coalesce((a.v - avg(a.v) OVER s) / nullif(stddev_samp(a.v) OVER s, 0), 'nan'::DOUBLE) AS z
  FROM appliance a JOIN placed p ON p.dataid = a.dataid WINDOW s AS (PARTITION BY a.sensor)),
z AS (SELECT zs.* FROM zs JOIN present e ON e.dataid = zs.dataid AND e.sensor = zs.sensor),
cut AS (
  SELECT city, community, dataid, sensor, idx AS win, avg(z) OVER xs AS x, avg(total) OVER ys AS y
  FROM z {_frames('city, community, dataid, sensor')}),
drift AS (SELECT city, community, dataid, sensor, avg(y) AS m FROM cut WHERE win <= 493 GROUP BY ALL),
naive AS (
  SELECT a.city, a.community, a.dataid, a.sensor, t.win, t.h, a.total AS y, d.m + c.x AS y_hat
  FROM targets t JOIN owned a ON a.idx = t.idx JOIN cut c ON c.dataid = a.dataid AND c.sensor = a.sensor AND c.win = t.win
  JOIN drift d ON d.dataid = a.dataid AND d.sensor = a.sensor)"""


def _errors(base: str, forecasts: str | None = None) -> str:
    above = LEVELS[LEVELS.index(base):]
    return f"WITH {FULL}, {TARGETS}, {forecasts or _naive(base)} " + " UNION ALL ".join(_level_rows(base, lv) for lv in above)


def _evaluation(base: str) -> str:
    return f"""
SELECT level, entity, win, round(mae, 4) AS mae,
       round(sqrt(sum(sse) OVER (PARTITION BY level, entity) / (count(*) OVER (PARTITION BY level, entity) * 12)), 4) AS rmse
FROM ({_errors(base)})"""


def _summary(base: str, forecasts: str | None = None) -> str:
    return f"""
SELECT base_level, level, entity, avg(mae) AS mae_mean, sqrt(sum(sse) / (count(*) * 12)) AS rmse_mean,
       stddev_samp(mae) AS mae_std, CASE WHEN count(*) > 1 THEN 0.0::DOUBLE END AS rmse_std
FROM ({_errors(base, forecasts)}) GROUP BY ALL"""


def _described(name: str, expr: str, frame: str) -> str:
    """Count, sum, first and last of a frame of rows, as the window queries report them."""
    return (f"CAST(count(*) OVER {frame} AS INTEGER) AS n_{name}, round(sum({expr}) OVER {frame}, 4) AS sum_{name}, "
            f"round(first_value({expr}) OVER {frame}, 4) AS first_{name}, round(last_value({expr}) OVER {frame}, 4) AS last_{name}")


DAILY = """
daily AS (
  SELECT user_id // 20 AS dataid, user_id % 20 AS s,
         CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) + 1 AS INTEGER) AS idx, sum(value) AS v
  FROM events GROUP BY ALL),
days AS (
  SELECT u.dataid, CAST(i AS INTEGER) AS idx FROM (SELECT DISTINCT user_id // 20 AS dataid FROM events) u, range(1, 31) t(i))"""

ORDER_SPANS = """
spans AS (
  SELECT *, CASE WHEN max_time + to_years(dy) >= TIMESTAMP '2000-09-30' THEN dy ELSE dy + 1 END AS delta_year FROM (
    SELECT o_custkey AS dataid, min(o_orderdate) AS min_time, max(o_orderdate) AS max_time,
           CAST(2000 - year(max(o_orderdate)) AS INTEGER) AS dy
    FROM orders GROUP BY 1)),
kept AS (SELECT * FROM spans WHERE min_time + to_years(delta_year) <= TIMESTAMP '2000-07-01')"""

LOGS = """
logs AS (
  SELECT user_id, event_type AS appliance, CAST(day(ts) - 1 AS INTEGER) AS epoch, value / 100 AS mae, value / 50 AS rmse
  FROM events)"""

# Calendar features of the grid times, scaled as the windows carry them.
SCALED_FEATURES = f"""
calendar AS (
  SELECT idx, (dayofyear - 1) / 365.0::DOUBLE AS dayofyear, (season - 1) / 3.0::DOUBLE AS season, ("month" - 1) / 11.0::DOUBLE AS "month",
         (dayofweek - 1) / 6.0::DOUBLE AS dayofweek, hourofday / 23.0::DOUBLE AS hourofday, minuteofhour / 59.0::DOUBLE AS minuteofhour,
         typeofday::DOUBLE AS typeofday
  FROM (SELECT idx, {CALENDAR} FROM spine))"""

FEATURE_SERIES = f"""{SCALED_FEATURES},
scaled AS (
  SELECT city, idx, total, (total - avg(total) OVER ()) / stddev_samp(total) OVER () AS z, calendar.* EXCLUDE (idx)
  FROM city JOIN calendar USING (idx))"""

# Appliances of placed households with their z-scores over the whole table of each sensor.
APPLIANCE_SERIES = f"""{SCALED_FEATURES},
scored AS (
  SELECT p.city, p.community, a.dataid, a.sensor, a.idx, a.v,
         (a.v - avg(a.v) OVER (PARTITION BY a.sensor)) / stddev_samp(a.v) OVER (PARTITION BY a.sensor) AS z
  FROM appliance a JOIN placed p ON p.dataid = a.dataid),
scaled AS (
  SELECT s.dataid, s.sensor, s.idx, s.v AS total, s.z, calendar.* EXCLUDE (idx)
  FROM scored s JOIN present e ON e.dataid = s.dataid AND e.sensor = s.sensor JOIN calendar ON calendar.idx = s.idx)"""

FEATURE_NAMES = ("dayofyear", "season", "month", "dayofweek", "hourofday", "minuteofhour", "typeofday")
FIELD_SUMS = ", ".join(f'round(sum("{f}") OVER xs, 4) AS sum_{f}' for f in FEATURE_NAMES)

# The default rule for held-out windows.
HELD_OUT = "('0x' || substr(md5('0:' || win), 1, 8))::BIGINT % 100 < 20"

LOAD = """
load AS (
  SELECT w.i AS win, count(e.idx) AS n_events FROM range(1, 721) w(i)
  LEFT JOIN (SELECT date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) + 1 AS idx FROM events) e
    ON e.idx BETWEEN w.i AND w.i + 71 GROUP BY 1)"""

PROFILE = """
SELECT dataid, min(ts) AS min_time, max(ts) AS max_time, count(*) AS n_readings,
       count(*) / (date_diff('hour', min(ts), max(ts)) + 1) AS data_availability,
       max(error) AS aggregation_abs_error_max, avg(error) AS aggregation_abs_error_mean,
       bool_or(air1 IS NOT NULL) AS air1, bool_or(kitchen1 IS NOT NULL) AS kitchen1,
       bool_or(car1 IS NOT NULL) AS car1, bool_or(solar IS NOT NULL) AS solar, bool_or(grid IS NOT NULL) AS grid
FROM (
  SELECT h.dataid, s.ts, air1, kitchen1, car1, solar, grid,
         CASE WHEN grid IS NOT NULL THEN
           abs(coalesce(air1, 0) + coalesce(kitchen1, 0) + coalesce(car1, 0) - (coalesce(solar, 0) + grid)) END AS error
  FROM hourly h JOIN spine s ON s.idx = h.idx)
GROUP BY dataid"""

CANDIDATES = """
wins AS (SELECT CAST(i AS INTEGER) AS win FROM range(1, 494) t(i) WHERE (i * 7919) % 100 < 20),
means AS (
  SELECT community, idx AS win, avg(total) OVER (
    PARTITION BY community ORDER BY idx ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING) AS m FROM community),
steps AS (SELECT CAST(i AS INTEGER) AS h FROM range(0, 12) t(i)),
scored AS (
  SELECT a.community, w.win, 'naive_' || l.lag AS candidate, abs(a.total - b.total) AS e
  FROM wins w, steps h, (VALUES (12), (24), (48), (72)) l(lag)
  JOIN community a ON a.idx = w.win + 72 + h.h
  JOIN community b ON b.community = a.community AND b.idx = a.idx - l.lag
  UNION ALL
  SELECT a.community, w.win, 'window_mean', abs(a.total - m.m)
  FROM wins w, steps h JOIN community a ON a.idx = w.win + 72 + h.h
  JOIN means m ON m.community = a.community AND m.win = w.win),
best AS (
  SELECT community, arg_min(candidate, val_mae) AS candidate, min(val_mae) AS val_mae
  FROM (SELECT community, candidate, avg(e) AS val_mae FROM scored GROUP BY ALL) GROUP BY community)"""

# Rungs of successive halving: windows of rung 0, those that rung 1 adds, the rest.
HALVING = """
wins AS (
  SELECT win, CASE WHEN d % 9 = 0 THEN 0 WHEN d % 3 = 0 THEN 1 ELSE 2 END AS rung FROM (
    SELECT CAST(i AS INTEGER) AS win, ('0x' || substr(md5('rung:' || i), 1, 8))::BIGINT AS d
    FROM range(1, 494) t(i) WHERE (i * 7919) % 100 < 20)),
means AS (
  SELECT community, idx AS win, avg(total) OVER (
    PARTITION BY community ORDER BY idx ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING) AS m FROM community),
steps AS (SELECT CAST(i AS INTEGER) AS h FROM range(0, 12) t(i)),
scored AS (
  SELECT community, rung, win, candidate, avg(e) AS e FROM (
    SELECT a.community, w.rung, w.win, 'naive_' || l.lag AS candidate, abs(a.total - b.total) AS e
    FROM wins w, steps h, (VALUES (12), (24), (36), (48), (60), (72)) l(lag)
    JOIN community a ON a.idx = w.win + 72 + h.h
    JOIN community b ON b.community = a.community AND b.idx = a.idx - l.lag
    UNION ALL
    SELECT a.community, w.rung, w.win, 'window_mean', abs(a.total - m.m)
    FROM wins w, steps h JOIN community a ON a.idx = w.win + 72 + h.h
    JOIN means m ON m.community = a.community AND m.win = w.win) GROUP BY ALL),
rung0 AS (
  SELECT community, candidate FROM scored WHERE rung = 0 GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY community ORDER BY avg(e), candidate) <= 3),
rung1 AS (
  SELECT community, candidate FROM scored JOIN rung0 USING (community, candidate) WHERE rung <= 1 GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY community ORDER BY avg(e), candidate) <= 1)"""

# Targets of the windows of three folds with their lags, as often as windows contain them.
FOLDS = """
folded AS (
  SELECT CAST(i AS INTEGER) AS win, CAST((i - 1) // 192 AS INTEGER) AS fold FROM range(1, 577) t(i) WHERE (i - 1) % 192 < 109),
targets_of AS MATERIALIZED (SELECT fold, win + 72 + h AS idx FROM folded, range(0, 12) s(h)),
lagged AS MATERIALIZED (
  SELECT community, idx, total AS y, lag(total, 12) OVER w AS x0, lag(total, 24) OVER w AS x1, lag(total, 48) OVER w AS x2
  FROM community WINDOW w AS (PARTITION BY community ORDER BY idx)),
pairs AS MATERIALIZED (SELECT l.*, t.fold FROM targets_of t JOIN lagged l ON l.idx = t.idx),
m AS (
  SELECT community, f.fold, {moments} FROM pairs, range(0, 3) f(fold) WHERE pairs.fold <> f.fold GROUP BY community, f.fold),
{two},
fold_scores AS (
  SELECT p.community, p.fold, c.candidate, sqrt(avg((p.y - CASE c.candidate
           WHEN 'naive_12' THEN x0 WHEN 'naive_24' THEN x1 WHEN 'naive_24_48' THEN (x1 + x2) / 2
           WHEN 'regression_24' THEN my + CASE WHEN v1 <= 0 THEN 0 ELSE c1 / v1 END * (x1 - m1)
           ELSE my + b1 * (x1 - m1) + b2 * (x2 - m2) END) ** 2)) AS rmse
  FROM pairs p JOIN b ON b.community = p.community AND b.fold = p.fold,
       (VALUES ('naive_12'), ('naive_24'), ('naive_24_48'), ('regression_24'), ('regression_24_48')) c(candidate) GROUP BY ALL)"""

LAG_PAIRS = """
SELECT {key} AS k, idx, total AS y, lag(total, 24) OVER (PARTITION BY {key} ORDER BY idx) AS y_lag FROM {level}
QUALIFY idx BETWEEN 73 AND 576"""

SCALARS = ", ".join(f"round({s}, 4) AS {s}" for s in SENSORS)


def _zscore(column: str, over: str = "") -> str:
    return f"round(({column} - avg({column}) OVER ({over})) / stddev_samp({column}) OVER ({over}), 4)"


def _level_union(select: str) -> str:
    """One SELECT per level above appliances; {level}, {key} and {series} are filled in."""
    keys = {"household": "dataid", "community": "community", "city": "city"}
    return " UNION ALL ".join(select.format(level=lv, key=k, series=lv) for lv, k in keys.items())


# Customers as households: orders moved to one summer, placed, filled and summed.
ORDER_LEVELS = f"""{ORDER_SPANS},
located AS (
  SELECT c.c_custkey AS dataid, r.r_name AS city, n.n_name AS state, c.c_mktsegment AS segment
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
homes AS (SELECT k.*, l.city, l.state, l.segment FROM kept k JOIN located l ON l.dataid = k.dataid),
placed AS (
  SELECT * REPLACE (CAST(community AS INTEGER) AS community) FROM (
    SELECT *, dense_rank() OVER (ORDER BY city, rn // 5) AS community FROM (
      SELECT *, row_number() OVER (PARTITION BY city ORDER BY dataid) - 1 AS rn FROM homes))
  QUALIFY count(*) OVER (PARTITION BY community) = 5),
daily AS (
  SELECT dataid, date_diff('day', TIMESTAMP '2000-07-01', ts) + 1 AS idx, sum(price) AS price FROM (
    SELECT o.o_custkey AS dataid, o.o_orderdate + to_years(p.delta_year) AS ts, o.o_totalprice AS price
    FROM orders o JOIN placed p ON p.dataid = o.o_custkey)
  WHERE ts BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2000-09-30' AND ts = date_trunc('day', ts) GROUP BY 1, 2),
household AS (
  SELECT p.city, p.community, p.dataid, CAST(s.i AS INTEGER) AS idx,
         coalesce(last_value(d.price IGNORE NULLS) OVER (
           PARTITION BY p.dataid ORDER BY s.i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS v
  FROM placed p CROSS JOIN range(1, 93) s(i) LEFT JOIN daily d ON d.dataid = p.dataid AND d.idx = s.i),
levels AS (
  SELECT 'appliance' AS name, CAST(dataid AS VARCHAR) AS entity, idx, v FROM household UNION ALL
  SELECT 'household', CAST(dataid AS VARCHAR), idx, v FROM household UNION ALL
  SELECT 'community', CAST(community AS VARCHAR), idx, sum(v) FROM household GROUP BY community, idx UNION ALL
  SELECT 'city', city, idx, sum(v) FROM household GROUP BY city, idx)"""


def _level_report(bases: tuple[str, ...], where: str = "TRUE") -> str:
    rows = " UNION ALL ".join(f"({_summary(b)})" for b in bases)
    return f"""
SELECT base_level, level, round(avg(mae_mean), 4) AS mae_mean, round(avg(rmse_mean), 4) AS rmse_mean,
       round(avg(mae_std), 4) AS mae_std, round(avg(rmse_std), 4) AS rmse_std FROM ({rows}) WHERE {where} GROUP BY 1, 2"""


def _report_of(base: str, forecasts: str) -> str:
    return f"""
SELECT base_level, level, round(avg(mae_mean), 4) AS mae_mean, round(avg(rmse_mean), 4) AS rmse_mean,
       round(avg(mae_std), 4) AS mae_std, round(avg(rmse_std), 4) AS rmse_std FROM ({_summary(base, forecasts)}) GROUP BY 1, 2"""


ORACLES: dict[str, str] = {
    "city_load_flagship": f"""
WITH {HOURLY}, {HOMES}
SELECT h.city, f.idx AS "index", round(sum(f.air1 + f.kitchen1 + f.car1 - f.solar), 4) AS total
FROM filled f JOIN homes h ON h.dataid = f.dataid GROUP BY 1, 2""",

    "time_spine_hours": f"""
WITH {HOURLY}
SELECT s.ts, s.idx AS "index", count(e.event_id) AS n_events
FROM spine s LEFT JOIN events e ON date_trunc('hour', e.ts) = s.ts GROUP BY 1, 2""",

    "grid_rows": f"""
WITH {HOURLY}
SELECT dataid, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(air1, kitchen1, car1, solar) IS NOT NULL) AS n_present,
       min(idx) AS first_index, max(idx) AS last_index FROM gaps GROUP BY 1""",

    "spine_fill": f'WITH {HOURLY} SELECT dataid, idx AS "index", {SCALARS} FROM filled',
    "spine_fill_blocks": f'WITH {HOURLY} SELECT dataid, idx AS "index", {SCALARS} FROM filled',
    "spine_join_fill": f'WITH {HOURLY} SELECT dataid, idx AS "index", {SCALARS} FROM filled',

    "household_profile": f"""
WITH {HOURLY}
SELECT dataid, min_time, max_time, n_readings, round(data_availability, 6) AS data_availability,
       round(aggregation_abs_error_max, 4) AS aggregation_abs_error_max,
       round(aggregation_abs_error_mean, 6) AS aggregation_abs_error_mean, air1, kitchen1, car1, solar, grid
FROM ({PROFILE})""",

    "year_alignment": f"WITH {ORDER_SPANS} SELECT dataid, min_time, max_time, CAST(delta_year AS INTEGER) AS delta_year FROM kept",

    "year_aligned_readings": f"""
WITH {ORDER_SPANS}
SELECT dataid, CAST(date_diff('day', TIMESTAMP '2000-07-01', ts) + 1 AS INTEGER) AS "index", round(sum(price), 2) AS price
FROM (SELECT o.o_custkey AS dataid, o.o_orderdate + to_years(k.delta_year) AS ts, o.o_totalprice AS price
      FROM orders o JOIN kept k ON k.dataid = o.o_custkey)
WHERE ts BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2000-09-30' AND ts = date_trunc('day', ts) GROUP BY 1, 2""",

    "community_assignment": f"WITH {HOMES} SELECT dataid, city, state, community FROM placed",
    "community_assignment_runs": f"WITH {HOMES} SELECT dataid, city, state, community FROM placed",
    "sensor_presence": f"WITH {HOMES}, {PRESENT} SELECT dataid, sensor FROM present",
    "hierarchy_edges": f"WITH {HOMES}, {PRESENT} SELECT city, community, dataid, sensor FROM present",

    "hierarchy_tree": f"""
WITH {HOMES}, {PRESENT}
SELECT city, community, CAST(count(DISTINCT p.dataid) AS INTEGER) AS n_households,
       CAST(count(e.sensor) AS INTEGER) AS n_appliances, min(p.dataid) AS first_household
FROM placed p LEFT JOIN (SELECT dataid, sensor FROM present) e ON e.dataid = p.dataid GROUP BY 1, 2""",

    "entity_lists": f"""
WITH {HOMES}
SELECT DISTINCT 'household' AS level, CAST(dataid AS VARCHAR) AS entity FROM placed UNION ALL
SELECT DISTINCT 'community', CAST(community AS VARCHAR) FROM placed UNION ALL
SELECT DISTINCT 'city', city FROM placed""",

    "entity_counts": f"""
WITH {HOMES}, {PRESENT}
SELECT 'appliance' AS level, count(*) AS n FROM present UNION ALL SELECT 'household', count(*) FROM placed UNION ALL
SELECT 'community', count(DISTINCT community) FROM placed UNION ALL SELECT 'city', count(DISTINCT city) FROM placed""",

    "row_zscore_outliers": f"""
WITH {DAILY}, stats AS (SELECT dataid, idx, avg(v) AS m, stddev_samp(v) AS sd FROM daily GROUP BY 1, 2),
kept AS (SELECT d.dataid, d.idx, d.v FROM daily d JOIN stats USING (dataid, idx)
         WHERE sd IS NULL OR sd = 0 OR abs((d.v - m) / sd) <= 3)
SELECT d.dataid, d.idx AS "index", CAST(count(k.v) AS INTEGER) AS n_kept, round(coalesce(sum(k.v), 0), 4) AS total_kept
FROM days d LEFT JOIN kept k ON k.dataid = d.dataid AND k.idx = d.idx GROUP BY 1, 2""",

    "abs_limit_outliers": f"""
WITH {DAILY}
SELECT d.dataid, d.idx AS "index", CAST(count(k.v) AS INTEGER) AS n_kept, round(coalesce(sum(k.v), 0), 4) AS total_kept
FROM days d LEFT JOIN daily k ON k.dataid = d.dataid AND k.idx = d.idx AND abs(k.v) <= 50 GROUP BY 1, 2""",

    "calendar_features": f"SELECT event_id, ts, {CALENDAR} FROM events",
    "calendar_features_scaled": f"""
SELECT event_id, round((dayofyear - 1) / 365.0::DOUBLE, 6) AS dayofyear, round((season - 1) / 3.0::DOUBLE, 6) AS season,
       round(("month" - 1) / 11.0::DOUBLE, 6) AS "month", round((dayofweek - 1) / 6.0::DOUBLE, 6) AS dayofweek,
       round(hourofday / 23.0::DOUBLE, 6) AS hourofday, round(minuteofhour / 59.0::DOUBLE, 6) AS minuteofhour, typeofday
FROM (SELECT event_id, {CALENDAR} FROM events)""",

    "household_total": f'WITH {BASE} SELECT dataid, idx AS "index", round(total, 4) AS total FROM household',
    "community_total": f'WITH {BASE} SELECT community, idx AS "index", round(total, 4) AS total FROM community',
    "city_total": f"""
WITH {BASE} SELECT c.city, s.ts, c.idx AS "index", {CALENDAR}, round(c.total, 4) AS total
FROM city c JOIN spine s ON s.idx = c.idx""",
    "city_total_joined": f"""
WITH {BASE} SELECT c.city, s.ts, c.idx AS "index", {CALENDAR}, round(c.total, 4) AS total
FROM city c JOIN spine s ON s.idx = c.idx""",
    "levels_grouping_sets": f"""
WITH {BASE}
SELECT 'community' AS level, city, community, idx AS "index", round(total, 4) AS total FROM community UNION ALL
SELECT 'city', city, 0, idx, round(total, 4) FROM city""",

    "zscore_sensors": f"""
WITH {HOURLY} SELECT dataid, idx AS "index", {', '.join(f'{_zscore(s)} AS {s}' for s in SENSORS)} FROM filled""",
    "zscore_levels": f"WITH {BASE} " + _level_union(
        "SELECT '{level}' AS level, CAST({key} AS VARCHAR) AS entity, idx AS \"index\", " + _zscore("total") + " AS total FROM {series}"),
    "zscore_fit_on_train": f"""
WITH {BASE} SELECT city, idx AS "index", round((total - (SELECT avg(total) FROM city WHERE idx <= 576))
  / (SELECT stddev_samp(total) FROM city WHERE idx <= 576), 4) AS total FROM city""",

    "split_windows": f"""
WITH {LOAD} SELECT CASE WHEN win <= 493 THEN 'train' ELSE 'test' END AS split, CAST(win AS INTEGER) AS win, n_events
FROM load WHERE win BETWEEN 1 AND 493 OR win BETWEEN 577 AND 637""",
    "kfold_windows": f"""
WITH {LOAD}, owned AS (SELECT win, n_events, (win - 1) // 192 AS owner FROM load WHERE win <= 576 AND (win - 1) % 192 < 109)
SELECT CAST(f.fold AS INTEGER) AS fold, CASE WHEN f.fold = owner THEN 'validation' ELSE 'train' END AS role,
       CAST(win AS INTEGER) AS win, n_events FROM owned, range(0, 3) f(fold)""",
    "validation_holdout": f"""
WITH {LOAD} SELECT CASE WHEN (win * 7919) % 100 < 20 THEN 'validation' ELSE 'train' END AS split,
       CAST(win AS INTEGER) AS win, n_events FROM load WHERE win <= 493""",

    "input_windows": f"""
WITH {BASE}, {FEATURE_SERIES}
SELECT * FROM (SELECT city, idx AS win, {_described('x', 'z', 'xs')}, {FIELD_SUMS} FROM scaled {_frames('city')})
WHERE win <= 637""",
    "appliance_input_windows": f"""
WITH {FULL}, {APPLIANCE_SERIES}
SELECT * FROM (SELECT dataid, sensor, idx AS win, {_described('x', 'z', 'xs')}, {FIELD_SUMS} FROM scaled {_frames('dataid, sensor')})
WHERE win BETWEEN 577 AND 637""",
    "appliance_training_pairs": f"""
WITH {FULL}, {APPLIANCE_SERIES}
SELECT * FROM (SELECT dataid, sensor, idx AS win, {_described('x', 'z', 'xs')}, {FIELD_SUMS}, {_described('y', 'total', 'ys')}
  FROM scaled {_frames('dataid, sensor')}) WHERE win <= 493""",
    "output_windows": f"""
WITH {BASE} SELECT * FROM (SELECT community, idx AS win, {_described('y', 'total', 'ys')} FROM community {_frames('community')})
WHERE win <= 637""",
    "training_pairs": f"""
WITH {BASE}, {FEATURE_SERIES}
SELECT * FROM (SELECT city, idx AS win, {_described('x', 'z', 'xs')}, {FIELD_SUMS}, {_described('y', 'total', 'ys')} FROM scaled {_frames('city')})
WHERE win <= 493""",
    "actual_windows": f"""
WITH {FULL} SELECT * FROM (
  SELECT dataid, sensor, idx AS win, {_described('y', 'total', 'ys')} FROM owned {_frames('dataid, sensor')})
WHERE win BETWEEN 577 AND 637""",

    "seasonal_naive": f"""
WITH {BASE}, {TARGETS} SELECT c.city, t.win, t.h, round(c.total, 7) AS y_hat FROM targets t JOIN city c ON c.idx = t.idx - 24""",
    "window_mean": f"""
WITH {BASE}, {TARGETS}
SELECT m.city, t.win, t.h, round(m.m, 7) AS y_hat FROM targets t JOIN (
  SELECT city, idx AS win, avg(total) OVER xs AS m FROM city {_frames('city')}) m ON m.win = t.win""",
    "lag_regression_entity": f"""
WITH {BASE}, pairs AS ({LAG_PAIRS.format(key='dataid', level='household')})
SELECT k AS dataid, CASE WHEN var_pop(y_lag) = 0 THEN 0.0 ELSE round(regr_slope(y, y_lag), 4) END AS slope,
       CASE WHEN var_pop(y_lag) = 0 THEN round(avg(y), 4) ELSE round(regr_intercept(y, y_lag), 4) END AS intercept
FROM pairs GROUP BY 1""",
    "lag_regression_forecast": f"""
WITH {BASE}, {TARGETS}, pairs AS ({LAG_PAIRS.format(key='city', level='city')}),
fits AS (SELECT k AS city, regr_slope(y, y_lag) AS b, regr_intercept(y, y_lag) AS a FROM pairs GROUP BY 1)
SELECT c.city, t.win, t.h, round(f.a + f.b * c.total, 7) AS y_hat
FROM targets t JOIN city c ON c.idx = t.idx - 24 JOIN fits f ON f.city = c.city""",
    "lag_regression_multi": f"""
WITH {BASE},
pairs AS (
  SELECT a.dataid, a.total AS y, p.total AS x1, q.total AS x2 FROM household a
  JOIN household p ON p.dataid = a.dataid AND p.idx = a.idx - 24
  JOIN household q ON q.dataid = a.dataid AND q.idx = a.idx - 48 WHERE a.idx BETWEEN 73 AND 576),
m AS (SELECT dataid, {MOMENTS_2} FROM pairs GROUP BY 1), {TWO_LAGS}
SELECT dataid, round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 4) AS weight_24, round(b2, 4) AS weight_48 FROM b""",
    "candidate_halving": f"""
WITH {BASE}, {HALVING}
SELECT community, candidate, round(avg(e), 7) AS val_mae, count(*) AS n_windows
FROM scored JOIN rung1 USING (community, candidate) GROUP BY 1, 2""",
    "kfold_scores": f"""
WITH {BASE}, {FOLDS.format(moments=MOMENTS_2, two=TWO_LAGS)}
SELECT community, fold, candidate, round(rmse, 4) AS rmse FROM fold_scores""",
    "kfold_best": f"""
WITH {BASE}, {FOLDS.format(moments=MOMENTS_2, two=TWO_LAGS)}
SELECT community, arg_min(candidate, rmse) AS candidate, round(min(rmse), 4) AS rmse
FROM (SELECT community, candidate, avg(rmse) AS rmse FROM fold_scores GROUP BY ALL) GROUP BY 1""",
    "window_statistics": f"""
WITH {BASE} SELECT * FROM (
  SELECT community, idx AS win, round(avg(total) OVER xs, 7) AS mean, round(stddev_samp(total) OVER xs, 4) AS std
  FROM community {_frames('community')}) WHERE win <= 637""",
    "user_aggregate_present": f"""
WITH {HOURLY} SELECT dataid, {', '.join(f'bool_or({s} IS NOT NULL) AS {s}' for s in (*SENSORS, 'grid'))} FROM hourly GROUP BY 1""",
    "lag_regression_global": f"""
WITH {BASE}, pairs AS ({LAG_PAIRS.format(key='community', level='community')})
SELECT 24 AS lag, round(regr_slope(y, y_lag), 4) AS slope, round(regr_intercept(y, y_lag), 4) AS intercept FROM pairs""",
    "candidate_search": f"WITH {BASE}, {CANDIDATES} SELECT community, candidate, round(val_mae, 7) AS val_mae FROM best",
    "candidate_forecast": f"""
WITH {BASE}, {TARGETS}, {CANDIDATES}
SELECT a.community, b.candidate, round(avg(abs(a.total - coalesce(p.total, m.m))), 7) AS mae
FROM targets t JOIN community a ON a.idx = t.idx JOIN best b ON b.community = a.community
LEFT JOIN community p ON p.community = a.community AND b.candidate LIKE 'naive_%'
  AND p.idx = a.idx - TRY_CAST(replace(b.candidate, 'naive_', '') AS INTEGER)
LEFT JOIN means m ON m.community = a.community AND m.win = t.win
GROUP BY 1, 2""",
    "validation_holdout_hash": f"""
WITH {LOAD} SELECT CASE WHEN {HELD_OUT} THEN 'validation' ELSE 'train' END AS split,
       CAST(win AS INTEGER) AS win, n_events FROM load WHERE win <= 493""",
    "candidate_search_fitted": f"""
WITH {BASE}, {TARGETS},
steps AS (SELECT CAST(i AS INTEGER) AS h FROM range(0, 12) t(i)),
wins AS (SELECT win, {HELD_OUT} AS held FROM (SELECT CAST(i AS INTEGER) AS win FROM range(1, 494) t(i))),
means AS (SELECT city, idx AS win, avg(total) OVER xs AS m FROM city {_frames('city')}),
lags AS (SELECT * FROM (VALUES (24), (48)) l(lag)),
early AS (
  SELECT a.city, lag, regr_slope(a.total, b.total) AS s, regr_intercept(a.total, b.total) AS i
  FROM wins w, steps h, lags JOIN city a ON a.idx = w.win + 72 + h.h JOIN city b ON b.city = a.city AND b.idx = a.idx - lag
  WHERE NOT w.held GROUP BY ALL),
late AS (
  SELECT a.city, lag, regr_slope(a.total, b.total) AS s, regr_intercept(a.total, b.total) AS i
  FROM lags, city a JOIN city b ON b.city = a.city AND b.idx = a.idx - lag WHERE a.idx BETWEEN 73 AND 576 GROUP BY ALL),
scored AS (
  SELECT a.city, 'naive_24' AS candidate, abs(a.total - b.total) AS e
  FROM wins w, steps h JOIN city a ON a.idx = w.win + 72 + h.h JOIN city b ON b.city = a.city AND b.idx = a.idx - 24 WHERE w.held
  UNION ALL
  SELECT a.city, 'regression_' || f.lag, abs(a.total - f.i - f.s * b.total)
  FROM wins w, steps h JOIN city a ON a.idx = w.win + 72 + h.h JOIN early f ON f.city = a.city
  JOIN city b ON b.city = a.city AND b.idx = a.idx - f.lag WHERE w.held
  UNION ALL
  SELECT a.city, 'window_mean', abs(a.total - m.m)
  FROM wins w, steps h JOIN city a ON a.idx = w.win + 72 + h.h JOIN means m ON m.city = a.city AND m.win = w.win WHERE w.held),
best AS (
  SELECT city, arg_min(candidate, val_mae) AS candidate, min(val_mae) AS val_mae
  FROM (SELECT city, candidate, avg(e) AS val_mae FROM scored GROUP BY ALL) GROUP BY city)
SELECT a.city, b.candidate, round(any_value(b.val_mae), 5) AS val_mae, round(avg(abs(a.total - CASE
         WHEN b.candidate = 'window_mean' THEN m.m WHEN f.lag IS NULL THEN p.total ELSE f.i + f.s * p.total END)), 5) AS mae
FROM targets t JOIN city a ON a.idx = t.idx JOIN best b ON b.city = a.city
LEFT JOIN late f ON f.city = a.city AND b.candidate = 'regression_' || f.lag
LEFT JOIN city p ON p.city = a.city AND p.idx = a.idx - coalesce(f.lag, 24)
LEFT JOIN means m ON m.city = a.city AND m.win = t.win
GROUP BY 1, 2""",
    "appliance_regression": f"""
WITH {','.join((HOURLY, HOMES, APPLIANCE.rsplit('),', 1)[0]))}),
pairs AS (
  SELECT a.dataid, a.sensor, a.idx, a.v AS y, lag(a.v, 24) OVER (PARTITION BY a.dataid, a.sensor ORDER BY a.idx) AS x
  FROM appliance a JOIN placed p ON p.dataid = a.dataid QUALIFY a.idx BETWEEN 73 AND 576)
SELECT dataid, sensor, CASE WHEN var_pop(x) = 0 THEN 0.0 ELSE round(regr_slope(y, x), 4) END AS slope,
       CASE WHEN var_pop(x) = 0 THEN round(avg(y), 4) ELSE round(regr_intercept(y, x), 4) END AS intercept
FROM pairs GROUP BY 1, 2""",
    "global_regression_forecast": f"""
WITH {BASE}, {TARGETS},
pairs AS (
  SELECT a.total AS y, b.total AS x1, c.total AS x2 FROM community a
  JOIN community b ON b.community = a.community AND b.idx = a.idx - 24
  JOIN community c ON c.community = a.community AND c.idx = a.idx - 48 WHERE a.idx BETWEEN 73 AND 576),
m AS (
  SELECT avg(y) AS y, avg(x1) AS x1, avg(x2) AS x2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
         covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM pairs),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT p.community, t.win, t.h, round(b.y - b1 * b.x1 - b2 * b.x2 + b1 * p.total + b2 * q.total, 7) AS y_hat
FROM b, targets t JOIN community p ON p.idx = t.idx - 24 JOIN community q ON q.community = p.community AND q.idx = t.idx - 48""",
    "user_model_levels": f"""
SELECT base_level, level, round(avg(mae_mean), 4) AS mae_mean, round(avg(rmse_mean), 4) AS rmse_mean,
       round(avg(mae_std), 4) AS mae_std, round(avg(rmse_std), 4) AS rmse_std
FROM ({' UNION ALL '.join(f"({_summary(b, _drifted(b))})" for b in LEVELS[1:])}) GROUP BY 1, 2""",
    "user_model_appliance": _report_of("appliance", DRIFTED_APPLIANCES),
    "global_model_appliance": _report_of("appliance", _two_lag_forecasts("appliance", "")),
    "entity_regression_levels": f"""
SELECT base_level, level, round(avg(mae_mean), 4) AS mae_mean, round(avg(rmse_mean), 4) AS rmse_mean,
       round(avg(mae_std), 4) AS mae_std, round(avg(rmse_std), 4) AS rmse_std
FROM ({' UNION ALL '.join(f"({_summary(b, _two_lag_forecasts(b, KEYS[b]))})" for b in LEVELS[1:])}) GROUP BY 1, 2""",
    "user_model_hook": f"""
WITH {BASE}, {TARGETS},
cut AS (SELECT city, idx AS win, avg(total) OVER xs AS x, avg(total) OVER ys AS y FROM city {_frames('city')}),
drift AS (SELECT city, avg(y) - avg(x) AS d FROM cut WHERE win <= 493 GROUP BY 1)
SELECT c.city, t.win, t.h, round(c.x + d.d, 7) AS y_hat
FROM targets t JOIN cut c ON c.win = t.win JOIN drift d ON d.city = c.city""",

    "bottomup_from_store": _evaluation("household"),
    "window_mae": f"""
WITH {BASE}, {TARGETS}
SELECT a.community, t.win, round(avg(abs(a.total - m.m)), 7) AS mae, round(sqrt(avg((a.total - m.m) * (a.total - m.m))), 4) AS rmse_window
FROM targets t JOIN community a ON a.idx = t.idx JOIN (
  SELECT community, idx AS win, avg(total) OVER xs AS m FROM community {_frames('community')}) m
  ON m.community = a.community AND m.win = t.win GROUP BY 1, 2""",
    "entity_rmse": f"""
WITH {BASE}, {TARGETS}, errors AS (
  SELECT a.dataid, t.win, a.total - m.m AS e
  FROM targets t JOIN household a ON a.idx = t.idx JOIN (
    SELECT dataid, idx AS win, avg(total) OVER xs AS m FROM household {_frames('dataid')}) m
    ON m.dataid = a.dataid AND m.win = t.win)
SELECT w.dataid, w.win, round(w.mae, 7) AS mae, round(r.rmse, 4) AS rmse
FROM (SELECT dataid, win, avg(abs(e)) AS mae FROM errors GROUP BY 1, 2) w
JOIN (SELECT dataid, sqrt(avg(e * e)) AS rmse FROM errors GROUP BY 1) r ON r.dataid = w.dataid""",
    "evaluation_summary": f"""
SELECT base_level, level, entity, round(mae_mean, 4) AS mae_mean, round(rmse_mean, 4) AS rmse_mean,
       round(mae_std, 4) AS mae_std, round(rmse_std, 4) AS rmse_std FROM ({_summary('household')})""",
    "level_report": _level_report(LEVELS),
    "evaluate_pipeline": _level_report(LEVELS),
    "evaluate_without_appliances": _level_report(LEVELS[1:]),
    "evaluate_subtree": _level_report(LEVELS[1:], "entity = 'ASIA' OR entity LIKE 'ASIA/%'"),
    "evaluation_sink": _evaluation("household"),
    "report_csv": _level_report(LEVELS[2:]),

    "training_curve_by_appliance": f"""
WITH {LOGS} SELECT appliance, epoch, round(avg(mae), 9) AS mae, round(avg(rmse), 9) AS rmse FROM logs GROUP BY 1, 2""",
    "training_curve": f"""
WITH {LOGS} SELECT epoch, round(avg(mae), 9) AS mae, round(avg(rmse), 9) AS rmse FROM (
  SELECT appliance, epoch, avg(mae) AS mae, avg(rmse) AS rmse FROM logs GROUP BY 1, 2) GROUP BY 1""",
    "training_curve_levels": f"""
WITH {LOGS}, {HOMES}, household AS (
  SELECT user_id AS dataid, epoch, avg(mae) AS mae, avg(rmse) AS rmse FROM logs GROUP BY 1, 2),
city AS (SELECT h.city, l.epoch, avg(l.mae) AS mae, avg(l.rmse) AS rmse FROM household l JOIN homes h ON h.dataid = l.dataid GROUP BY 1, 2),
community AS (
  SELECT p.community, l.epoch, avg(l.mae) AS mae, avg(l.rmse) AS rmse FROM household l JOIN placed p ON p.dataid = l.dataid GROUP BY 1, 2)
SELECT 'household' AS level, epoch, round(avg(mae), 9) AS mae, round(avg(rmse), 9) AS rmse FROM household GROUP BY 2 UNION ALL
SELECT 'community', epoch, round(avg(mae), 9), round(avg(rmse), 9) FROM community GROUP BY 2 UNION ALL
SELECT 'city', epoch, round(avg(mae), 9), round(avg(rmse), 9) FROM city GROUP BY 2""",

    "mean_load": f"""
WITH {','.join((HOURLY, HOMES, PRESENT, TOTALS))},
base AS (SELECT avg(total) AS m FROM city WHERE idx >= 577),
counts AS (
  SELECT 'appliance' AS level, count(*) AS n FROM present UNION ALL SELECT 'household', count(*) FROM placed UNION ALL
  SELECT 'community', count(DISTINCT community) FROM placed UNION ALL SELECT 'city', count(DISTINCT city) FROM placed)
SELECT level, round(base.m * (SELECT n FROM counts WHERE level = 'city') / counts.n, 7) AS mean FROM counts, base""",
    "std_load": f"WITH {BASE} " + _level_union(
        "SELECT '{level}' AS level, round(avg(sd), 4) AS std FROM "
        "(SELECT stddev_samp(total) AS sd FROM {series} WHERE idx >= 577 GROUP BY {key})"),
    "std_load_appliance": f"""
WITH {FULL} SELECT round(sum(sd) / count(*), 4) AS std FROM (
  SELECT stddev_samp(total) AS sd FROM owned WHERE idx >= 577 GROUP BY dataid, sensor)""",

    "roundtrip_partitioned": f"""
WITH {BASE} SELECT city, idx AS "index", round(total, 4) AS total FROM city WHERE city = 'ASIA' AND idx > 600""",
    "roundtrip_bucketed": f"""
WITH {HOURLY} SELECT dataid, idx AS "index", round(air1 + kitchen1 + car1 - solar, 4) AS total FROM filled
WHERE dataid IN (3, 7, 11, 12, 14)""",
    "read_entity_bucketed": f"""
WITH {HOURLY} SELECT dataid, idx AS "index", round(air1 + kitchen1 + car1 - solar, 4) AS total FROM filled WHERE dataid = 7""",
    "roundtrip_append": f'WITH {BASE} SELECT dataid, idx AS "index", round(total, 4) AS total FROM household',
    "roundtrip_overwritten_partitions": f"""
WITH {BASE} SELECT city, idx AS "index", round(CASE WHEN city = 'ASIA' THEN 2 * total ELSE total END, 4) AS total FROM city""",
    "csv_profile_roundtrip": f"""
WITH {HOURLY}, {HOMES}
SELECT CAST(p.dataid AS INTEGER) AS dataid, h.city, min_time, max_time, floor(data_availability * 10000) / 100 AS availability,
       floor(aggregation_abs_error_max * 100) / 100 AS aggregation_abs_error_max, air1, kitchen1, car1, solar, grid
FROM ({PROFILE.replace('FROM hourly h', '''FROM (SELECT dataid, idx, round(air1, 2) AS air1, round(kitchen1, 2) AS kitchen1,
    round(car1, 2) AS car1, round(solar, 2) AS solar, round(grid, 2) AS grid FROM hourly) h''')}) p
LEFT JOIN placed h ON h.dataid = p.dataid""",
    "csv_readings_by_name": f"""
WITH {HOURLY} SELECT h.dataid, s.ts, air1, kitchen1, car1, solar, grid FROM hourly h JOIN spine s ON s.idx = h.idx""",
    "log_tree_curves": f"""
WITH {LOGS} SELECT appliance, epoch, round(avg(mae), 9) AS mae, round(avg(rmse), 9) AS rmse FROM logs GROUP BY 1, 2""",
    "evaluation_tree_summary": f"""
WITH {LOGS} SELECT CAST(user_id AS VARCHAR) AS household, round(avg(mae), 9) AS mae_mean, round(avg(rmse), 9) AS rmse_mean,
       round(stddev_samp(mae), 9) AS mae_std, round(stddev_samp(rmse), 9) AS rmse_std FROM logs GROUP BY 1""",
    "preprocess_levels": f"""
WITH {ORDER_LEVELS}
SELECT name, entity, idx AS "index", round(v, 4) AS value FROM levels UNION ALL
SELECT 'normalized_' || name, entity, idx,
       round((v - avg(v) OVER (PARTITION BY name)) / stddev_samp(v) OVER (PARTITION BY name), 4) FROM levels""",
    "generated_metadata": f"""
WITH {ORDER_LEVELS}
SELECT p.dataid, city, state, segment, min_time, max_time, o.n AS n_readings, CAST(delta_year AS INTEGER) AS delta_year,
       community, TRUE AS price
FROM placed p JOIN (SELECT o_custkey AS dataid, count(*) AS n FROM orders GROUP BY 1) o ON o.dataid = p.dataid""",
    "profile_source_metadata": f"""
WITH {ORDER_LEVELS}
SELECT o.dataid, city, state, segment, n AS n_readings
FROM (SELECT o_custkey AS dataid, count(*) AS n FROM orders GROUP BY 1) o
LEFT JOIN (SELECT * FROM located WHERE dataid IN (SELECT user_id FROM events)) l ON l.dataid = o.dataid""",
    "matrix_roundtrip": f"""
WITH {BASE}, {TARGETS} SELECT c.city, t.win, t.h, round(c.total, 7) AS y_hat FROM targets t JOIN city c ON c.idx = t.idx - 24""",
}
ORACLES["partition_hook"] = ORACLES["training_curve"]
ORACLES.update({f"bottomup_{base}": _evaluation(base) for base in LEVELS})
