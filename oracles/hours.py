"""Tickets, hour slots and the statistics over a day's hours."""

from math import comb

from oracles.base import (
    EVENT_HOURS, EVENT_TICKETS, LINE_TICKETS, TALLY_OUT, TICKET_OUT, VALID, VALID_RULE,
    big, day, dbl, hour_grid, label, r6, txt,
)

S = {}

S["ticket_scan"] = f"WITH {EVENT_TICKETS} SELECT {TICKET_OUT} FROM tickets"
S["valid_tickets"] = f"WITH {EVENT_TICKETS} SELECT {TICKET_OUT} FROM tickets WHERE {VALID_RULE}"
S["ticket_extract"] = f"""WITH {LINE_TICKETS} SELECT {TICKET_OUT} FROM tickets WHERE {VALID_RULE}
  ORDER BY report_date, ts"""
S["range_filter"] = f"""WITH {LINE_TICKETS} SELECT {TICKET_OUT} FROM tickets
  WHERE report_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""
S["business_day"] = f"""WITH {EVENT_TICKETS}, d AS (
    SELECT ticket_id, report_date AS business_date, (hour(ts) + 6) % 24 AS slot FROM tickets)
  SELECT {big('ticket_id')}, {day('business_date')}, {big('slot')}, {label('slot')} AS slot_label,
    strftime(CAST(business_date AS TIMESTAMP) - INTERVAL 6 HOUR + to_hours(slot), '%Y-%m-%d %H:%M:%S.%f') AS slot_start
  FROM d"""
S["clean_numeric"] = """
  SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    CASE WHEN l_tax = 0 OR l_tax = 0.08 OR l_tax = 0.01 THEN 0 ELSE l_tax END AS tax,
    CASE WHEN l_discount IN (0, 0.01, 0.02) THEN 0 ELSE l_discount END AS discount
  FROM lineitem"""

S["hourly_tally"] = f"WITH {EVENT_HOURS} SELECT {day()}, {big('slot')}, {label('slot')} AS time_label, {TALLY_OUT} FROM hours"
_SECOND = hour_grid(keep="(EXTRACT(minute FROM ts) * 60 + EXTRACT(microsecond FROM ts) / 1000000.0 <= 3599)")
S["hourly_tally_second"] = f"""WITH {EVENT_TICKETS}, {VALID}, {_SECOND}
  SELECT {day()}, {big('slot')}, {label('slot')} AS time_label, {TALLY_OUT} FROM hours"""
_BOTH = hour_grid(places="""placed AS (
  SELECT CAST(p + INTERVAL 6 HOUR AS DATE) AS report_date, CAST((hour(p) + 6) % 24 AS INTEGER) AS slot,
    prod_line, cane_type, net_weight, truck_q
  FROM (SELECT *, ts AS p FROM valid WHERE prod_line IN ('A', 'B') UNION ALL
        SELECT *, ts - INTERVAL 1 HOUR FROM valid WHERE prod_line IN ('A', 'B') AND ts = date_trunc('hour', ts)))""")
S["hourly_tally_closed"] = f"""WITH {LINE_TICKETS}, {VALID}, {_BOTH}
  SELECT {day()}, {big('slot')}, {label('slot')} AS time_label, {big('a_count', 'b_count', 'total_count')},
    {dbl('a_tons', 'b_tons', 'total_tons')} FROM hours"""
S["hourly_with_total"] = f"""WITH {EVENT_HOURS}, rows AS (
    SELECT report_date, slot, {label('slot')} AS time_label, FALSE AS is_total, a_count, b_count, total_count,
      a_tons, b_tons, fresh_tons, burnt_tons, total_tons FROM hours
    UNION ALL
    SELECT report_date, NULL, 'TOTAL', TRUE, SUM(a_count), SUM(b_count), SUM(total_count),
      SUM(a_tons), SUM(b_tons), SUM(fresh_tons), SUM(burnt_tons), SUM(total_tons) FROM hours GROUP BY report_date)
  SELECT {day()}, {big('slot')}, time_label, {txt('is_total')}, {TALLY_OUT} FROM rows"""
S["hourly_rollup"] = f"""WITH {EVENT_TICKETS},\n{VALID}, placed AS (
    SELECT *, CAST((hour(ts) + 6) % 24 AS INTEGER) AS slot FROM valid)
  SELECT CASE GROUPING_ID(report_date, slot) WHEN 0 THEN 'slot' WHEN 1 THEN 'day' ELSE 'season' END AS level,
    {day()}, {big('slot')}, COUNT(*) FILTER (WHERE prod_line = 'A') AS a_count, COUNT(*) FILTER (WHERE prod_line = 'B') AS b_count,
    COUNT(*) FILTER (WHERE prod_line IN ('A', 'B')) AS total_count, {', '.join(
      f"CAST(COALESCE(SUM(net_weight) FILTER (WHERE {rule}), 0) AS DOUBLE) AS {name}" for name, rule in (
          ('a_tons', "prod_line = 'A'"), ('b_tons', "prod_line = 'B'"), ('fresh_tons', "cane_type = '1'"),
          ('burnt_tons', "cane_type = '2'"), ('total_tons', "prod_line IN ('A', 'B')")))}
  FROM placed GROUP BY ROLLUP (report_date, slot)"""
# Every fifth ticket on the full hour.
_MIXED = EVENT_TICKETS.replace("FROM events", """FROM (
    SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts) FROM events)""")
S["hourly_closed_mixed"] = S["hourly_tally_closed"].replace(LINE_TICKETS, _MIXED)
S["hourly_both_mixed"] = f"""WITH {_MIXED}, {VALID}, twice AS (
    SELECT ts, prod_line, cane_type, net_weight FROM valid
    UNION ALL SELECT ts - INTERVAL 1 HOUR, prod_line, cane_type, net_weight FROM valid WHERE ts = date_trunc('hour', ts)),
  {hour_grid(places="""placed AS (SELECT CAST(ts + INTERVAL 6 HOUR AS DATE) AS report_date,
    CAST((hour(ts) + 6) % 24 AS INTEGER) AS slot, prod_line, cane_type, net_weight FROM twice)""")}
  SELECT {day()}, {big('slot')}, {label('slot')} AS time_label, {TALLY_OUT} FROM hours"""
# The lax collation spelled out: no case, no trailing blanks.
_LOOSE = EVENT_TICKETS.replace("ELSE '5' END AS print_q", "ELSE '5' END || repeat(' ', event_id % 3) AS print_q").replace(
    "ELSE '2' END AS cane_type", "ELSE '2' END || repeat(' ', event_id % 3) AS cane_type").replace(
    "'y' AS print_w", "CASE WHEN event_id % 2 = 0 THEN 'Y' ELSE 'y' END || repeat(' ', event_id % 3) AS print_w").replace(
    "CAST(user_id AS VARCHAR) AS lane_code", "CAST(user_id AS VARCHAR) || repeat(' ', event_id % 3) AS lane_code")
_LAX_RULE = VALID_RULE
for _name in ("print_q", "cane_type", "print_w", "lane_code"):
    _LAX_RULE = _LAX_RULE.replace(_name, f"lower(rtrim({_name}))")
S["valid_tickets_ci"] = f"""WITH {_LOOSE}, lax AS (SELECT * FROM tickets WHERE {_LAX_RULE})
  SELECT {day()}, CAST(SUM(net_weight) AS DOUBLE) AS tons, COUNT(*) AS trucks,
    COUNT(*) FILTER (WHERE rtrim(cane_type) = '1') AS fresh_trucks,
    CAST(COALESCE(SUM(net_weight) FILTER (WHERE rtrim(cane_type) = '1'), 0) AS DOUBLE) AS fresh_tons,
    CAST(COALESCE(SUM(net_weight) FILTER (WHERE rtrim(cane_type) = '1'), 0) AS DOUBLE) / CAST(SUM(net_weight) AS DOUBLE) * 100 AS fresh_pct
  FROM lax GROUP BY report_date"""
S["hour_efficiency"] = f"""WITH {EVENT_HOURS}
  SELECT {day()}, {big('slot')}, {dbl('total_tons')},
    CASE WHEN total_tons > 600 THEN 'high' WHEN total_tons > 400 THEN 'normal'
         WHEN total_tons > 0 THEN 'low' ELSE 'none' END AS efficiency FROM hours"""
S["sorted_tally"] = f"""WITH {EVENT_HOURS}
  SELECT {day()}, {big('slot')}, printf('%,.2f', CAST(total_tons AS DOUBLE)) AS total_text FROM hours
  ORDER BY total_tons DESC"""
S["heatmap"] = f"""WITH {EVENT_TICKETS}
  SELECT {day()}, {', '.join(f"CAST(COALESCE(SUM(net_weight) FILTER (WHERE hour(ts) = {h}), 0) AS DOUBLE) AS h{h:02d}" for h in range(24))}
  FROM tickets WHERE print_q = '5' GROUP BY report_date"""
S["cumulative"] = f"""WITH {EVENT_HOURS}
  SELECT {day()}, {big('slot')}, {', '.join(
      f"CAST(SUM({c}) OVER (PARTITION BY report_date ORDER BY slot) AS DOUBLE) AS cum_{c}"
      for c in ('a_tons', 'b_tons', 'fresh_tons', 'burnt_tons'))} FROM hours"""
S["moving_avg"] = f"""WITH {EVENT_HOURS}, w AS (
    SELECT *, LAG(total_tons) OVER d AS p, LEAD(total_tons) OVER d AS n FROM hours
    WINDOW d AS (PARTITION BY report_date ORDER BY slot))
  SELECT {day()}, {big('slot')}, {dbl('total_tons')}, CAST(p + total_tons + n AS DOUBLE) / 3 AS moving_avg FROM w"""
S["day_averages"] = f"""WITH {EVENT_HOURS}
  SELECT {day()}, {', '.join(f"CAST(SUM({c}) AS DOUBLE) / 24 AS avg_{c}" for c in ('a_count', 'b_count', 'a_tons', 'b_tons'))}
  FROM hours GROUP BY report_date"""
S["exec_summary"] = f"""WITH {EVENT_HOURS}, a AS (
    SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY total_tons DESC, slot) AS best,
      row_number() OVER (PARTITION BY report_date ORDER BY slot DESC) AS latest
    FROM hours WHERE total_tons > 0),
  s AS (SELECT report_date, COUNT(*) AS active_hours, SUM(total_tons) AS day_tons,
      MAX(CASE WHEN best = 1 THEN slot END) AS peak_slot, MAX(CASE WHEN best = 1 THEN total_tons END) AS peak_tons,
      MAX(CASE WHEN latest = 1 THEN slot END) AS latest_slot, MAX(CASE WHEN latest = 1 THEN total_tons END) AS latest_tons
    FROM a GROUP BY report_date)
  SELECT {day()}, {big('active_hours', 'peak_slot', 'latest_slot')}, {dbl('day_tons', 'peak_tons', 'latest_tons')},
    {label('peak_slot')} AS peak_label, {label('latest_slot')} AS latest_label,
    CAST(day_tons AS DOUBLE) / active_hours * 24 AS forecast_tons,
    CASE WHEN active_hours < 6 THEN 'early' WHEN active_hours < 12 THEN 'half_day' ELSE 'full_day' END AS forecast_label
  FROM s"""

# --- statistics battery --------------------------------------------------------------
# Even degrees of freedom (22): 1 - sin * sum of C(2k, k) / 4^k * cos^2k for k = 0..10.
_SUM = " + ".join(f"{comb(2 * k, k) / 4 ** k!r} * pow(cos(theta), {2 * k})" for k in range(11))
_P = f"CASE WHEN r0 IS NULL THEN 1 WHEN 1 - r0 * r0 <= 0 THEN 0 ELSE GREATEST(0, 1 - sin(theta) * ({_SUM})) END"
BATTERY = f"""b0 AS (
  SELECT report_date, COUNT(*) AS n, SUM(total_tons) AS tons, SUM(total_count) AS trucks,
    SUM(a_tons) AS a_sum, SUM(b_tons) AS b_sum,
    COUNT(*) FILTER (WHERE total_tons > 0) AS active_hours,
    MAX(total_tons) AS max_tons, MIN(total_tons) AS min_tons,
    COUNT(*) FILTER (WHERE total_tons >= 600) AS high_hours,
    COUNT(*) FILTER (WHERE total_tons >= 400 AND total_tons < 600) AS medium_hours,
    COUNT(*) FILTER (WHERE total_tons >= 200 AND total_tons < 400) AS low_hours,
    COUNT(*) FILTER (WHERE total_tons < 200) AS idle_hours,
    regr_slope(CAST(total_tons AS DOUBLE), slot) AS slope0,
    regr_intercept(CAST(total_tons AS DOUBLE), slot) AS intercept,
    corr(CAST(total_tons AS DOUBLE), slot) AS r0,
    stddev_pop(CAST(total_tons AS DOUBLE)) AS std_pop, var_pop(CAST(total_tons AS DOUBLE)) AS var_pop,
    stddev_samp(CAST(total_tons AS DOUBLE)) AS std_samp,
    quantile_cont(CAST(total_tons AS DOUBLE), 0.25) AS q25,
    quantile_cont(CAST(total_tons AS DOUBLE), 0.5) AS q50,
    quantile_cont(CAST(total_tons AS DOUBLE), 0.75) AS q75,
    CAST(SUM(total_tons) FILTER (WHERE slot < 12) AS DOUBLE) / 12 AS first_half_avg,
    CAST(SUM(total_tons) FILTER (WHERE slot >= 12) AS DOUBLE) / 12 AS second_half_avg
  FROM hours GROUP BY report_date),
b1 AS (
  SELECT *, COALESCE(slope0, 0) AS slope, COALESCE(r0, 0) AS r,
    atan(abs(r0 * sqrt(22 / NULLIF(GREATEST(1 - r0 * r0, 0), 0))) / sqrt(22)) AS theta,
    CAST(tons AS DOUBLE) / n AS mean_tons, q75 - q25 AS iqr,
    active_hours / 24.0::DOUBLE AS efficiency_ratio,
    CASE WHEN trucks > 0 THEN CAST(tons AS DOUBLE) / trucks ELSE 0 END AS tons_per_truck,
    CASE WHEN b_sum > 0 THEN CAST(a_sum AS DOUBLE) / CAST(b_sum AS DOUBLE) ELSE 0 END AS balance_ratio
  FROM b0),
b2 AS (
  SELECT *, {_P} AS p_value,
    CASE WHEN mean_tons > 0 THEN std_pop / mean_tons * 100 ELSE 0 END AS cv_pct,
    CASE WHEN first_half_avg > 0 THEN (second_half_avg - first_half_avg) / first_half_avg * 100 ELSE 0 END AS change_pct,
    CASE WHEN slope > 0.5 THEN 'increasing' WHEN slope < -0.5 THEN 'decreasing' ELSE 'stable' END AS direction,
    CASE WHEN abs(slope) <= 0.5 THEN 'weak' WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
    CASE WHEN balance_ratio >= 0.8 AND balance_ratio <= 1.2 THEN 'balanced' ELSE 'unbalanced' END AS balance,
    efficiency_ratio * 100 AS efficiency_score,
    GREATEST(0, 100 - CASE WHEN mean_tons > 0 THEN std_samp / mean_tons * 100 ELSE 100 END) AS consistency_score,
    LEAST(100, tons_per_truck / 10 * 100) AS productivity_score,
    CASE WHEN a_sum + b_sum = 0 THEN 0 ELSE
      GREATEST(0, 100 - abs(CAST(a_sum AS DOUBLE) / CAST(a_sum + b_sum AS DOUBLE) - 0.5) * 200) END AS balance_score
  FROM b1),
b3 AS (
  SELECT *, efficiency_score * 0.3 + consistency_score * 0.25 + productivity_score * 0.25 + balance_score * 0.2 AS overall_index,
    CASE WHEN cv_pct < 20 THEN 'very_stable' WHEN cv_pct < 40 THEN 'stable' WHEN cv_pct < 60 THEN 'moderate'
         ELSE 'unstable' END AS stability
  FROM b2),
bat AS (
  SELECT *, CASE WHEN overall_index >= 80 THEN 'excellent' WHEN overall_index >= 70 THEN 'good'
    WHEN overall_index >= 60 THEN 'fair' WHEN overall_index >= 50 THEN 'poor' ELSE 'very_poor' END AS level
  FROM b3),
ranked AS (
  SELECT h.*, row_number() OVER (PARTITION BY report_date ORDER BY total_tons DESC, slot) AS rk FROM hours h),
peak AS (
  SELECT h.report_date, h.slot FROM hours h JOIN bat USING (report_date)
  WHERE CAST(h.total_tons AS DOUBLE) >= q75)"""
EB = f"WITH {EVENT_HOURS},\n{BATTERY}\n"

S["hourly_metrics"] = EB + f"""SELECT {day()}, {dbl('tons', 'max_tons', 'min_tons')},
    {big('trucks', 'active_hours', 'high_hours', 'medium_hours', 'low_hours', 'idle_hours')},
    CAST(tons AS DOUBLE) / 24 AS tons_per_hour,
    CASE WHEN active_hours > 0 THEN CAST(tons AS DOUBLE) / active_hours ELSE 0 END AS tons_per_active_hour,
    tons_per_truck, efficiency_ratio FROM bat"""
S["hourly_trend"] = EB + f"""SELECT {day()}, direction, strength, {r6('slope')}, {r6('intercept')}, {r6('r')},
    {r6('p_value')}, {r6('change_pct')}, {dbl('first_half_avg', 'second_half_avg')} FROM bat"""
S["hourly_variability"] = EB + f"""SELECT {day()}, {dbl('mean_tons')}, {r6('std_pop')}, {r6('var_pop')}, {r6('cv_pct')},
    {r6('q25')}, {r6('q50')}, {r6('q75')}, {r6('iqr')}, stability FROM bat"""
S["hourly_outliers"] = EB + f""", o AS (
    SELECT report_date, slot FROM hours JOIN bat USING (report_date)
    WHERE CAST(total_tons AS DOUBLE) < q25 - 1.5 * iqr OR CAST(total_tons AS DOUBLE) > q75 + 1.5 * iqr)
  SELECT {day('bat.report_date')}, CAST(COUNT(o.slot) AS BIGINT) AS outlier_count,
    COALESCE(string_agg(CAST(o.slot AS VARCHAR), ',' ORDER BY o.slot), '') AS outlier_slots
  FROM bat LEFT JOIN o USING (report_date) GROUP BY bat.report_date"""
S["peak_periods"] = EB + f"""SELECT CAST(b.report_date AS VARCHAR) AS report_date, {r6('b.q75', 'threshold')},
    CAST(p.c AS BIGINT) AS peak_count, p.slots AS peak_slots, CAST(p.c AS DOUBLE) / b.n AS peak_ratio,
    CAST(k.slot AS BIGINT) AS best_slot, {label('k.slot')} AS best_label, CAST(k.total_tons AS DOUBLE) AS best_tons
  FROM bat b JOIN ranked k ON k.report_date = b.report_date AND k.rk = 1
  JOIN (SELECT report_date, COUNT(*) AS c, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots
        FROM peak GROUP BY report_date) p ON p.report_date = b.report_date"""
S["peak_runs"] = EB + f""", g AS (
    SELECT report_date, slot, slot - row_number() OVER (PARTITION BY report_date ORDER BY slot) AS island FROM peak)
  SELECT {day()}, CAST(MIN(slot) AS BIGINT) AS first_slot, CAST(MAX(slot) AS BIGINT) AS last_slot,
    CAST(COUNT(*) AS BIGINT) AS length FROM g GROUP BY report_date, island HAVING COUNT(*) >= 2"""
_SERIES = ("a_tons", "b_tons", "fresh_tons", "burnt_tons", "total_tons")
_CORR = " UNION ALL ".join(
    f"SELECT report_date, '{x}' AS series, '{y}' AS other, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS c FROM hours GROUP BY report_date"
    for i, x in enumerate(_SERIES) for y in _SERIES[i:])
S["hourly_correlation"] = EB + f""", c AS ({_CORR})
  SELECT {day()}, balance_ratio, balance, series, other,
    ROUND(COALESCE(CASE WHEN isnan(c) THEN NULL ELSE c END, 0), 6) AS corr FROM c JOIN bat USING (report_date)"""
S["performance_index_hourly"] = EB + f"""SELECT {day()}, {r6('efficiency_score')}, {r6('consistency_score')},
    {r6('productivity_score')}, {r6('balance_score')}, {r6('overall_index')}, level FROM bat"""
S["hourly_insights"] = EB + f""", f AS (
    SELECT report_date, 'ACTIVE_HOURS' AS code, CAST(active_hours AS DOUBLE) AS value FROM bat
    UNION ALL SELECT report_date, 'TONS_PER_HOUR', CAST(tons AS DOUBLE) / 24 FROM bat WHERE tons > 0
    UNION ALL SELECT report_date, 'TREND_' || upper(direction),
      CASE direction WHEN 'increasing' THEN change_pct WHEN 'decreasing' THEN abs(change_pct) END FROM bat
    UNION ALL SELECT report_date, 'STABILITY_' || upper(stability), cv_pct FROM bat WHERE stability <> 'moderate'
    UNION ALL SELECT report_date, 'BEST_HOUR', CAST(max_tons AS DOUBLE) FROM bat
    UNION ALL SELECT report_date, 'INDEX_' || upper(level), overall_index FROM bat)
  SELECT {day()}, code, {r6('value')} FROM f"""
S["hourly_recommendations"] = EB + f""", n AS (SELECT report_date, COUNT(*) AS peak_count FROM peak GROUP BY report_date), f AS (
    SELECT report_date, 'high' AS priority, 'EFFICIENCY' AS code, efficiency_ratio AS value FROM bat WHERE efficiency_ratio < 0.5
    UNION ALL SELECT report_date, 'medium', 'STABILITY', cv_pct FROM bat WHERE stability = 'unstable'
    UNION ALL SELECT report_date, 'medium', 'BALANCE', balance_ratio FROM bat WHERE balance = 'unbalanced'
    UNION ALL SELECT report_date, 'low', 'PEAK_PERFORMANCE', peak_count FROM n WHERE peak_count < 6)
  SELECT {day()}, priority, code, {r6('value')} FROM f"""
S["next_hour_forecast"] = f"""WITH {EVENT_HOURS}, w AS (
    SELECT *, LAG(total_tons, 1) OVER d AS p1, LAG(total_tons, 2) OVER d AS p2 FROM hours
    WINDOW d AS (PARTITION BY report_date ORDER BY slot)),
  m AS (SELECT *, CAST(p2 + p1 + total_tons AS DOUBLE) / 3 AS mean3,
      (CAST(total_tons AS DOUBLE) - CAST(p2 AS DOUBLE)) / 3 AS rise FROM w WHERE p2 IS NOT NULL),
  s AS (SELECT *, mean3 + rise AS predicted_tons, sqrt((pow(p2::DOUBLE - mean3, 2) + pow(p1::DOUBLE - mean3, 2)
      + pow(total_tons::DOUBLE - mean3, 2)) / 2) AS std_tons FROM m)
  SELECT {day()}, CAST(slot AS BIGINT) AS current_hour, CAST(slot + 1 AS BIGINT) AS prediction_hour,
    mean3 AS moving_avg, rise AS trend, predicted_tons, {r6('std_tons')},
    {r6('GREATEST(0, predicted_tons - 1.96 * std_tons)', 'lower')},
    {r6('predicted_tons + 1.96 * std_tons', 'upper')},
    CASE WHEN std_tons < 10 THEN 'high' WHEN std_tons < 20 THEN 'medium' ELSE 'low' END AS confidence FROM s"""
_RANK = """, o AS (SELECT *, row_number() OVER (ORDER BY overall_index DESC, report_date) AS top,
      row_number() OVER (ORDER BY overall_index, report_date) AS bottom FROM bat)"""
S["range_comparison"] = EB + _RANK + f"""
  SELECT CAST(COUNT(*) AS BIGINT) AS days, {r6('AVG(overall_index)', 'avg_index')},
    {r6('AVG(efficiency_ratio)', 'avg_efficiency_ratio')},
    CAST(MAX(CASE WHEN top = 1 THEN report_date END) AS VARCHAR) AS best_day,
    {r6('MAX(CASE WHEN top = 1 THEN overall_index END)', 'best_index')},
    CAST(MAX(CASE WHEN bottom = 1 THEN report_date END) AS VARCHAR) AS worst_day,
    {r6('MAX(CASE WHEN bottom = 1 THEN overall_index END)', 'worst_index')} FROM o"""
S["best_worst_day"] = EB + _RANK + f"""
  SELECT 'best' AS kind, {day()}, {r6('overall_index')} FROM o WHERE top = 1
  UNION ALL SELECT 'worst', {day()}, {r6('overall_index')} FROM o WHERE bottom = 1"""
S["hourly_export"] = S["hourly_tally"]
S["stream_hourly_tally"] = f"""WITH {EVENT_HOURS}
  SELECT {day()}, {big('slot')}, {TALLY_OUT} FROM hours
  WHERE a_count + b_count > 0 OR fresh_tons + burnt_tons > 0"""
S["stream_day_total"] = f"""WITH {EVENT_HOURS}
  SELECT {day()}, {', '.join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in ('a_count', 'b_count', 'total_count'))},
    {', '.join(f"CAST(SUM({c}) AS DOUBLE) AS {c}" for c in ('a_tons', 'b_tons', 'fresh_tons', 'burnt_tons', 'total_tons'))},
    CAST(COUNT(*) FILTER (WHERE total_tons > 0) AS BIGINT) AS active_hours FROM hours GROUP BY report_date"""
S["efficiency_report"] = EB + f"""SELECT {day()}, {dbl('tons')}, {big('trucks', 'active_hours')}, efficiency_ratio,
    {r6('overall_index')}, level, direction, {r6('slope')}, stability, balance,
    (SELECT string_agg(CAST(p.slot AS VARCHAR), ',' ORDER BY p.slot) FROM peak p WHERE p.report_date = bat.report_date) AS peak_slots,
    CAST(24 AS BIGINT) AS breakdown_rows FROM bat"""

S["stream_hourly_late"] = S["stream_hourly_tally"]

STATEMENTS = S
