"""Daily, monthly and season tallies and the trailing windows."""

from oracles.base import (
    CLOCK_TICKETS, EVENT_DAYS, EVENT_HOURS, LINE_TICKETS, TICKET_OUT, VALID, big, day, dbl, r6, txt,
)

S = {}
L = f"WITH {LINE_TICKETS},\n{VALID}"

_T = "COALESCE(SUM(net_weight), 0)"


def where(condition):
    return f"COALESCE(SUM(net_weight) FILTER (WHERE {condition}), 0)"


A, B, FRESH, BURNT = (where(c) for c in ("prod_line = 'A'", "prod_line = 'B'", "cane_type = '1'", "cane_type = '2'"))

S["season_totals"] = f"""{L} SELECT CAST({A} AS DOUBLE) AS a_tons, CAST({B} AS DOUBLE) AS b_tons,
    CAST({FRESH} AS DOUBLE) AS fresh_tons, CAST({BURNT} AS DOUBLE) AS burnt_tons,
    COUNT(*) FILTER (WHERE prod_line = 'A') AS a_trucks, COUNT(*) FILTER (WHERE prod_line = 'B') AS b_trucks,
    COUNT(*) AS all_trucks,
    (SELECT CAST(SUM(net_weight) AS DOUBLE) FROM tickets WHERE print_q = '5') AS season_tons FROM valid"""
S["season_totals_view"] = S["season_totals"]
S["daily_by_line"] = f"""{L} SELECT {day()}, CAST({A} AS DOUBLE) AS a_tons, CAST({B} AS DOUBLE) AS b_tons,
    CAST({_T} AS DOUBLE) AS total_tons FROM tickets WHERE print_q = '5' GROUP BY report_date"""
_DAILY = f"""dw AS (SELECT report_date, {_T} AS tons, COUNT(*) AS trucks, {FRESH} AS fresh_tons, {BURNT} AS burnt_tons,
    {A} AS a_tons, {B} AS b_tons, COUNT(*) FILTER (WHERE prod_line = 'A') AS a_trucks,
    COUNT(*) FILTER (WHERE prod_line = 'B') AS b_trucks,
    COUNT(*) FILTER (WHERE cane_type = '1') AS fresh_trucks FROM valid GROUP BY report_date)"""
S["daily_weight"] = f"""{L}, {_DAILY} SELECT {day()}, {big('trucks')},
    {dbl('tons', 'fresh_tons', 'burnt_tons', 'a_tons', 'b_tons')} FROM dw"""
S["daily_weight_summary"] = f"""{L}, {_DAILY} SELECT COUNT(*) AS days, CAST(SUM(tons) AS DOUBLE) AS total_tons,
    CAST(SUM(tons) AS DOUBLE) / COUNT(*) AS avg_tons, CAST(MAX(tons) AS DOUBLE) AS max_tons,
    CAST(MIN(tons) AS DOUBLE) AS min_tons FROM dw"""
S["monthly"] = f"""{L} SELECT strftime(report_date, '%Y-%m') AS month, CAST({_T} AS DOUBLE) AS tons,
    CAST({FRESH} AS DOUBLE) AS fresh_tons, CAST({BURNT} AS DOUBLE) AS burnt_tons, CAST({A} AS DOUBLE) AS a_tons,
    CAST({B} AS DOUBLE) AS b_tons, COUNT(*) AS trucks, COUNT(*) FILTER (WHERE cane_type = '1') AS fresh_trucks,
    COUNT(*) FILTER (WHERE cane_type = '2') AS burnt_trucks FROM valid GROUP BY 1 ORDER BY 1"""
S["season_trend"] = f"""{L} SELECT strftime(report_date, '%Y-%m') AS month, CAST({_T} AS DOUBLE) AS tons,
    COUNT(*) AS tickets, CAST({FRESH} AS DOUBLE) AS fresh_tons, CAST({BURNT} AS DOUBLE) AS burnt_tons,
    CAST({_T} AS DOUBLE) / COUNT(*) AS avg_ticket_tons
  FROM valid WHERE report_date >= DATE '1995-09-15' - INTERVAL 6 MONTH GROUP BY 1 ORDER BY 1 DESC"""
S["ticket_stats"] = f"""{L} SELECT COUNT(*) AS tickets, CAST({_T} AS DOUBLE) / COUNT(*) AS avg_tons,
    ROUND(stddev_samp(CAST(net_weight AS DOUBLE)), 6) AS std_tons, CAST(MIN(net_weight) AS DOUBLE) AS min_tons,
    CAST(MAX(net_weight) AS DOUBLE) AS max_tons FROM valid WHERE report_date >= DATE '1995-06-30' - INTERVAL 30 DAY"""
S["fresh_trend"] = f"""{L} SELECT {day()}, CAST({FRESH} AS DOUBLE) / CAST({_T} AS DOUBLE) * 100 AS fresh_pct
  FROM valid WHERE report_date >= DATE '1995-06-30' - INTERVAL 14 DAY GROUP BY report_date ORDER BY report_date"""
S["daily_training_agg"] = f"""{L}, {_DAILY} SELECT {day()}, {dbl('tons', 'fresh_tons')}, {big('trucks', 'fresh_trucks')},
    CASE WHEN tons > 0 THEN CAST(fresh_tons AS DOUBLE) / CAST(tons AS DOUBLE) * 100 ELSE 0 END AS fresh_pct FROM dw"""


def _share(x, y):
    return (f"CASE WHEN {x} + {y} > 0 THEN CAST({x} AS DOUBLE) / CAST({x} + {y} AS DOUBLE) * 100 ELSE 0 END")


S["share_panel"] = f"""{L}, {_DAILY}, s AS (SELECT SUM(a_tons) AS sa, SUM(b_tons) AS sb, SUM(a_trucks) AS ta,
    SUM(b_trucks) AS tb, SUM(fresh_tons) AS sf, SUM(burnt_tons) AS su FROM dw)
  SELECT {day()}, {_share('fresh_tons', 'burnt_tons')} AS fresh_pct, {_share('burnt_tons', 'fresh_tons')} AS burnt_pct,
    {_share('sa', 'sb')} AS season_a_tons_pct, {_share('sb', 'sa')} AS season_b_tons_pct,
    {_share('ta', 'tb')} AS season_a_trucks_pct, {_share('tb', 'ta')} AS season_b_trucks_pct,
    {_share('sf', 'su')} AS season_fresh_pct, {_share('su', 'sf')} AS season_burnt_pct FROM dw, s"""

# --- trailing windows: theta joins on the daily table ----------------------------------
_SPANS = """sp AS (
  SELECT d.report_date, COUNT(x.report_date) FILTER (WHERE d.report_date - x.report_date <= 7) AS n1,
    COUNT(x.report_date) FILTER (WHERE d.report_date - x.report_date > 7) AS n2,
    CAST(SUM(x.tons) FILTER (WHERE d.report_date - x.report_date <= 7) AS DOUBLE) AS t1,
    CAST(SUM(x.tons) FILTER (WHERE d.report_date - x.report_date > 7) AS DOUBLE) AS t2,
    CAST(SUM(x.fresh_tons) FILTER (WHERE d.report_date - x.report_date <= 7) AS DOUBLE) AS f1,
    CAST(SUM(x.fresh_tons) FILTER (WHERE d.report_date - x.report_date > 7) AS DOUBLE) AS f2
  FROM dw d LEFT JOIN dw x ON x.report_date BETWEEN d.report_date - 14 AND d.report_date - 1 GROUP BY d.report_date)"""
W = f"{L}, {_DAILY}, {_SPANS}"
S["baseline_7d"] = f"""{W} SELECT {day()}, CASE WHEN n1 > 0 THEN t1 / n1 ELSE 0 END AS avg_daily_tons,
    CASE WHEN t1 > 0 THEN f1 / t1 * 100 ELSE 0 END AS avg_fresh_percent,
    CAST(n1 > 0 AS VARCHAR) AS has_comparison_data FROM sp"""
S["trend_7v7"] = f"""{W} SELECT {day()}, CAST(n1 > 0 AND n2 > 0 AS VARCHAR) AS has_trend_data,
    CASE WHEN n1 > 0 AND n2 > 0 THEN (t1 / n1 - t2 / n2) / (t2 / n2) * 100 END AS tons_trend_percent,
    CASE WHEN n1 > 0 AND n2 > 0 THEN f1 / t1 * 100 - f2 / t2 * 100 END AS fresh_trend_percent FROM sp"""
_ROLL = """CASE WHEN n1 >= 3 AND t1 > 0 THEN t1 / n1 ELSE 0 END AS avg_daily_tons,
    CASE WHEN n1 >= 3 AND t1 > 0 THEN f1 / t1 * 100 ELSE 0 END AS avg_fresh_percent,
    CAST(n1 >= 3 AND COALESCE(t1, 0) > 0 AS VARCHAR) AS has_comparison_data"""
_PCT = "CASE WHEN {0}tons > 0 THEN CAST({0}fresh_tons AS DOUBLE) / CAST({0}tons AS DOUBLE) * 100 ELSE 0 END"
S["rolling_baseline"] = f"""{W} SELECT {day()}, {dbl('tons', 'fresh_tons')}, {_PCT.format('')} AS fresh_pct, {_ROLL}
  FROM sp JOIN dw USING (report_date)"""
S["rolling_trend"] = f"""{W} SELECT {day()},
    CASE WHEN n1 > 0 AND n2 > 0 THEN (t1 - t2) / t2 * 100 ELSE 0 END AS tons_trend_percent,
    CASE WHEN n1 > 0 AND n2 > 0 THEN f1 / t1 * 100 - f2 / t2 * 100 ELSE 0 END AS fresh_trend_percent FROM sp"""
S["ticket_with_baseline"] = f"""{W} SELECT {TICKET_OUT}, CAST(dw.tons AS DOUBLE) AS day_tons,
    CAST(dw.fresh_tons AS DOUBLE) AS day_fresh_tons, {_PCT.format('dw.')} AS day_fresh_pct, {_ROLL}
  FROM valid LEFT JOIN dw USING (report_date) LEFT JOIN sp USING (report_date)"""
S["performance_index"] = f"""WITH {EVENT_DAYS} SELECT {day()}, tons AS line_tons, {big('active_hours')},
    performance_index FROM rec"""
_WEEKS = f"""pd AS (SELECT report_date, {_T} AS tons, COUNT(*) AS trucks FROM tickets WHERE print_q = '5' GROUP BY report_date),
  wk AS (SELECT b.report_date AS base_date, d.report_date, d.tons, d.trucks,
      CASE WHEN d.report_date >= b.report_date - 6 THEN 'current' ELSE 'previous' END AS period
    FROM pd b JOIN pd d ON d.report_date BETWEEN b.report_date - 13 AND b.report_date)"""
S["week_compare_daily"] = f"WITH {LINE_TICKETS}, {_WEEKS} SELECT {day('base_date')}, {day()}, period, {dbl('tons')}, {big('trucks')} FROM wk"
S["week_compare"] = f"""WITH {LINE_TICKETS}, {_WEEKS}, g AS (SELECT base_date,
    COALESCE(CAST(SUM(tons) FILTER (WHERE period = 'current') AS DOUBLE), 0) AS current_tons,
    COALESCE(CAST(SUM(tons) FILTER (WHERE period = 'previous') AS DOUBLE), 0) AS previous_tons,
    COUNT(*) FILTER (WHERE period = 'current') AS nc, COUNT(*) FILTER (WHERE period = 'previous') AS np FROM wk GROUP BY base_date),
  a AS (SELECT *, CASE WHEN nc > 0 THEN current_tons / nc ELSE 0 END AS current_avg,
    CASE WHEN np > 0 THEN previous_tons / np ELSE 0 END AS previous_avg FROM g)
  SELECT {day('base_date')}, current_tons, previous_tons, current_avg, previous_avg,
    CASE WHEN previous_avg > 0 THEN (current_avg - previous_avg) / previous_avg * 100 ELSE 0 END AS change_pct FROM a"""

# --- ranges: the full result cut to the range ----------------------------------------------
def _cut(statement, column="report_date", first="1996-02-20", last="1997-03-10"):
    return f"SELECT * FROM ({statement}) WHERE {column} BETWEEN '{first}' AND '{last}'"


for _name in ("baseline_7d", "trend_7v7", "rolling_baseline", "rolling_trend"):
    S[f"{_name}_range"] = _cut(S[_name])
S["week_compare_range"] = _cut(S["week_compare"], "base_date")
# A base date needs no tickets of its own here.
S["week_compare_day"] = f"""WITH {LINE_TICKETS}, pd AS (SELECT report_date, {_T} AS tons, COUNT(*) AS trucks FROM tickets
    WHERE print_q = '5' GROUP BY report_date)
  SELECT '1997-03-10' AS base_date, {day()}, CASE WHEN report_date >= DATE '1997-03-04' THEN 'current' ELSE 'previous' END AS period,
    {dbl('tons')}, {big('trucks')} FROM pd WHERE report_date BETWEEN DATE '1997-02-25' AND DATE '1997-03-10'"""
S["distinct_trucks"] = f"""{L} SELECT strftime(report_date, '%Y-%m') AS month, COUNT(DISTINCT report_date) AS days,
    COUNT(DISTINCT truck_q) AS trucks, 'true' AS near FROM valid GROUP BY 1"""

# --- training records and features -----------------------------------------------------
_TRAIN = f"""{_DAILY}, {_SPANS},
hr AS (SELECT report_date, hour(ts) AS hh, SUM(net_weight) AS ht FROM valid GROUP BY report_date, hour(ts)),
pk AS (SELECT report_date, COUNT(*) AS active_hours, MAX(ht) AS peak_tons FROM hr GROUP BY report_date),
ph AS (SELECT hr.report_date, MIN(hh) AS peak_hour FROM hr JOIN pk ON pk.report_date = hr.report_date AND ht = peak_tons
  GROUP BY hr.report_date),
la AS (SELECT report_date, ts AS latest_ts, net_weight AS latest_tons, row_number() OVER (
    PARTITION BY report_date ORDER BY ts DESC, ticket_id DESC) AS rn FROM valid),
tr AS (
  SELECT report_date, CAST(dw.tons AS DOUBLE) AS tons, {_PCT.format('dw.')} AS fresh_pct,
    CASE WHEN n1 >= 3 AND t1 > 0 THEN t1 / n1 ELSE 0 END AS avg_tons,
    CASE WHEN n1 >= 3 AND t1 > 0 THEN f1 / t1 * 100 ELSE 0 END AS avg_fresh_pct,
    n1 >= 3 AND COALESCE(t1, 0) > 0 AS has_baseline, active_hours, CAST(peak_tons AS DOUBLE) AS peak_tons, peak_hour,
    latest_ts, CAST(latest_tons AS DOUBLE) AS latest_tons, trucks AS tickets,
    CASE WHEN n1 > 0 AND n2 > 0 THEN (t1 - t2) / t2 * 100 ELSE 0 END AS tons_trend,
    CASE WHEN n1 > 0 AND n2 > 0 THEN f1 / t1 * 100 - f2 / t2 * 100 ELSE 0 END AS fresh_trend
  FROM dw JOIN sp USING (report_date) JOIN pk USING (report_date) JOIN ph USING (report_date)
  JOIN (SELECT * FROM la WHERE rn = 1) USING (report_date)),
sc AS (
  SELECT *,
    CASE WHEN avg_tons > 0 THEN CASE WHEN (tons - avg_tons) / avg_tons * 100 > 15 THEN 5
      WHEN (tons - avg_tons) / avg_tons * 100 > 5 THEN 4 WHEN (tons - avg_tons) / avg_tons * 100 < -20 THEN 1
      WHEN (tons - avg_tons) / avg_tons * 100 < -10 THEN 2 ELSE 3 END ELSE 3 END AS quantity,
    CASE WHEN avg_fresh_pct > 0 THEN CASE WHEN fresh_pct - avg_fresh_pct > 5 THEN 5 WHEN fresh_pct - avg_fresh_pct > 2 THEN 4
      WHEN fresh_pct - avg_fresh_pct < -8 THEN 1 WHEN fresh_pct - avg_fresh_pct < -4 THEN 2 ELSE 3 END ELSE 3 END AS quality,
    CASE WHEN peak_tons / (tons / active_hours) < 1.3 THEN 5 WHEN peak_tons / (tons / active_hours) < 1.6 THEN 4
      WHEN peak_tons / (tons / active_hours) < 2.5 THEN 2 ELSE 1 END AS stability
  FROM tr)"""
TRAIN = f"WITH {CLOCK_TICKETS},\n{VALID},\n{_TRAIN}\n"
S["training_records"] = TRAIN + f"""SELECT {day()}, tons, avg_tons, fresh_pct, avg_fresh_pct, {txt('has_baseline')},
    {big('active_hours', 'peak_hour', 'tickets', 'quantity', 'quality', 'stability')}, peak_tons, latest_tons,
    strftime(latest_ts, '%Y-%m-%d %H:%M:%S.%f') AS latest_ts, 'true' AS has_trend, tons_trend, fresh_trend
  FROM sc WHERE has_baseline"""
S["ml_features"] = TRAIN + f"""SELECT {day()}, tons, avg_tons, fresh_pct, avg_fresh_pct, CAST(active_hours AS BIGINT) AS active_hours,
    peak_tons, tons_trend, fresh_trend, tons / avg_tons AS quantity_ratio,
    CASE WHEN avg_fresh_pct > 0 THEN fresh_pct / avg_fresh_pct ELSE 1 END AS quality_ratio,
    peak_tons / (tons / active_hours) AS peak_share,
    abs(tons_trend) AS abs_tons_trend, abs(fresh_trend) AS abs_fresh_trend,
    CASE WHEN month(report_date) IN (12, 1, 2, 3, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS in_season_flag,
    tons AS label_tons, fresh_pct AS label_fresh,
    CASE WHEN (quantity + quality + stability) / 3.0::DOUBLE >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label_good
  FROM sc WHERE has_baseline"""
_PRED = """, p AS (SELECT *, avg_tons * 1.2::DOUBLE AS predicted_tons, avg_fresh_pct + tons_trend AS predicted_fresh,
    (quantity + quality + stability) / 15.0::DOUBLE AS p_good FROM sc WHERE has_baseline)"""
S["ml_clamp"] = TRAIN + _PRED + f""", c AS (SELECT *,
    predicted_tons < 0 OR predicted_tons > tons * 1.4::DOUBLE OR predicted_tons < tons * 0.6::DOUBLE AS odd_t,
    predicted_fresh < 0 OR predicted_fresh > 100 AS odd_f FROM p),
  k AS (SELECT *, CASE WHEN odd_t THEN tons ELSE predicted_tons END AS clamped_tons,
    CASE WHEN odd_f THEN fresh_pct ELSE predicted_fresh END AS clamped_fresh, odd_t OR odd_f AS adjusted FROM c),
  z AS (SELECT *, GREATEST(-25, LEAST(25, (clamped_tons - tons) / tons * 100)) AS tons_change_pct,
    clamped_fresh - fresh_pct AS fresh_change FROM k)
  SELECT {day()}, tons, predicted_tons, clamped_tons, clamped_fresh, {txt('adjusted')}, tons_change_pct, fresh_change,
    CASE WHEN abs(tons_change_pct) < 3 THEN 'steady' WHEN tons_change_pct > 3 THEN 'up' ELSE 'down' END AS tons_outlook,
    CASE WHEN abs(fresh_change) < 1.5 THEN 'steady' WHEN fresh_change > 1.5 THEN 'better' ELSE 'worse' END AS fresh_outlook,
    CASE WHEN adjusted THEN 'medium' ELSE 'high' END AS confidence FROM z"""
S["model_compare"] = TRAIN + _PRED + f""", c AS (SELECT report_date,
    concat_ws(',', CASE WHEN tons > predicted_tons * 1.1::DOUBLE THEN 'TONS_ABOVE_PREDICTION'
        WHEN tons < predicted_tons * 0.9::DOUBLE THEN 'TONS_BELOW_PREDICTION' END,
      CASE WHEN fresh_pct > predicted_fresh + 5 THEN 'FRESH_ABOVE_PREDICTION'
        WHEN fresh_pct < predicted_fresh - 5 THEN 'FRESH_BELOW_PREDICTION' END,
      CASE WHEN p_good > 0.8 THEN 'GOOD_DAY_LIKELY' WHEN p_good < 0.3 THEN 'GOOD_DAY_UNLIKELY' END) AS f,
    concat_ws(',', CASE WHEN tons < predicted_tons * 0.9::DOUBLE THEN 'CHECK_TRANSPORT' END,
      CASE WHEN fresh_pct < predicted_fresh - 5 THEN 'CHECK_BURNT_HANDLING' END,
      CASE WHEN p_good < 0.3 THEN 'FIND_CAUSES' END) AS a FROM p)
  SELECT {day()}, CASE f WHEN '' THEN 'NORMAL' ELSE f END AS model_findings,
    CASE a WHEN '' THEN 'KEEP_STANDARD' ELSE a END AS model_actions FROM c"""
S["model_outlook"] = TRAIN + _PRED + f""", c AS (SELECT report_date, (predicted_tons - tons) / tons * 100 AS outlook_tons_pct,
    predicted_fresh - fresh_pct AS outlook_fresh_pp FROM p)
  SELECT {day()}, outlook_tons_pct, outlook_fresh_pp,
    CASE WHEN outlook_tons_pct > 5 AND outlook_fresh_pp > 2 THEN 'up'
      WHEN outlook_tons_pct < -5 OR outlook_fresh_pp < -2 THEN 'down' ELSE 'flat' END AS outlook,
    CASE WHEN abs(outlook_tons_pct) < 5 AND abs(outlook_fresh_pp) < 2 THEN 'high'
      WHEN abs(outlook_tons_pct) > 15 OR abs(outlook_fresh_pp) > 8 THEN 'low' ELSE 'medium' END AS outlook_confidence FROM c"""

_LOG = f"""{L}, lg AS (SELECT CAST(MIN(report_date) AS VARCHAR) AS "start", CAST(MAX(report_date) AS VARCHAR) AS "end",
    strftime(MAX(report_date), '%Y-%m-%d') || ' 00:00:00' AS trained_at FROM valid GROUP BY year(report_date))"""
S["trained_ranges"] = f"""{_LOG} SELECT "start", "end", trained_at FROM lg ORDER BY "start" """
S["trained_years"] = f"""{_LOG} SELECT COUNT(*) AS "count", (SELECT string_agg(y, ',' ORDER BY y) FROM (
    SELECT DISTINCT substr("start", 1, 4) AS y FROM lg UNION SELECT DISTINCT substr("end", 1, 4) FROM lg)) AS years FROM lg"""

S["train_log"] = f"""{L} SELECT CAST(year(report_date) AS VARCHAR) AS run_id,
    strftime(MAX(report_date), '%Y-%m-%d') || ' 00:00:00' AS trained_at, CAST(MIN(report_date) AS VARCHAR) AS first_day,
    CAST(MAX(report_date) AS VARCHAR) AS last_day, COUNT(DISTINCT report_date) AS days_used, COUNT(*) AS tickets
  FROM valid GROUP BY year(report_date)
  UNION ALL SELECT '0', '1990-01-01 00:00:00', '1989-01-01', '1989-12-31', 0, 0"""

_FEATURES = ("tons", "avg_tons", "fresh_pct", "avg_fresh_pct", "active_hours", "peak_tons", "tons_trend", "fresh_trend",
             "quantity_ratio", "quality_ratio", "peak_share", "abs_tons_trend", "abs_fresh_trend", "in_season_flag")
S["scaler_stats"] = f"WITH m AS ({S['ml_features']})" + " UNION ALL ".join(
    f" SELECT '{f}' AS feature, ROUND(AVG({f}), 6) AS mean, ROUND(stddev_samp({f}), 6) AS std FROM m" for f in _FEATURES)
S["model_facts"] = f"WITH m AS ({S['ml_features']})" + " UNION ALL ".join(
    f""" SELECT '{name}' AS model, COUNT(*) AS days, ROUND(MIN({y}), 6) AS label_min, ROUND(MAX({y}), 6) AS label_max,
    ROUND(AVG({y}), 6) AS label_mean, ROUND(var_pop({y}), 6) AS mean_error, 'true' AS inside,
    'true' AS same_after_reload, 'true' AS better_than_mean FROM m"""
    for name, y in (("tons", "label_tons"), ("fresh", "label_fresh"), ("good", "label_good")))

STATEMENTS = S
