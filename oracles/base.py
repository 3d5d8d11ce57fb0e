"""Common table expressions shared by the statements."""

EVENT_TICKETS = """tickets AS (
  SELECT event_id AS ticket_id, ts, CAST(ts + INTERVAL 6 HOUR AS DATE) AS report_date,
    CAST(value AS DECIMAL(18,2)) AS net_weight,
    CASE WHEN event_type IN ('click', 'view') THEN 'A'
         WHEN event_type IN ('purchase', 'signup') THEN 'B' END AS prod_line,
    CASE WHEN user_id % 4 <> 0 THEN '1' ELSE '2' END AS cane_type,
    CASE WHEN event_type = 'error' THEN '0' ELSE '5' END AS print_q,
    'y' AS print_w, CAST(user_id AS VARCHAR) AS lane_code, CAST(user_id AS VARCHAR) AS truck_q
  FROM events)"""


def _lineitem(ts, day):
    return f"""tickets AS (
  SELECT l_orderkey * 10 + l_linenumber AS ticket_id, {ts} AS ts, {day} AS report_date,
    CAST(l_quantity AS DECIMAL(18,2)) AS net_weight,
    CASE l_linestatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' END AS prod_line,
    CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE '3' END AS cane_type,
    '5' AS print_q, 'y' AS print_w, CAST(l_suppkey AS VARCHAR) AS lane_code,
    CAST(l_orderkey AS VARCHAR) AS truck_q
  FROM lineitem)"""


LINE_TICKETS = _lineitem("l_shipdate", "CAST(l_shipdate AS DATE)")
_CLOCK = ("(l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) + to_minutes(CAST(l_orderkey % 60 AS BIGINT))"
          " + to_seconds(CAST(l_linenumber AS BIGINT)))")
CLOCK_TICKETS = _lineitem(_CLOCK, f"CAST({_CLOCK} + INTERVAL 6 HOUR AS DATE)")

VALID_RULE = """print_q = '5' AND cane_type IN ('1', '2') AND print_w = 'y' AND net_weight > 0
    AND lane_code NOT IN ('10', '20', '30', '31', '40', '41', '50', '80', '81')"""
VALID = f"valid AS (SELECT * FROM tickets WHERE {VALID_RULE})"

LABEL = """(lpad(CAST((slot + 18) % 24 AS VARCHAR), 2, '0') || ':00-' ||
    lpad(CAST((slot + 19) % 24 AS VARCHAR), 2, '0') || ':00')"""


def label(slot):
    return LABEL.replace("slot", slot)


def hour_grid(source="valid", places=None, keep="TRUE"):
    """`hours`: 24 rows per day. `places` may replace the (report_date, slot, row) relation."""
    placed = places or f"placed AS (SELECT *, CAST((hour(ts) + 6) % 24 AS INTEGER) AS slot FROM {source})"
    return f"""{placed},
sums AS (
  SELECT report_date, slot,
    COUNT(*) FILTER (WHERE prod_line = 'A' AND {keep}) AS a_count,
    SUM(net_weight) FILTER (WHERE prod_line = 'A' AND {keep}) AS a_tons,
    COUNT(*) FILTER (WHERE prod_line = 'B' AND {keep}) AS b_count,
    SUM(net_weight) FILTER (WHERE prod_line = 'B' AND {keep}) AS b_tons,
    SUM(net_weight) FILTER (WHERE cane_type = '1' AND {keep}) AS fresh_tons,
    SUM(net_weight) FILTER (WHERE cane_type = '2' AND {keep}) AS burnt_tons
  FROM placed GROUP BY report_date, slot),
hours AS (
  SELECT d.report_date, CAST(g.slot AS INTEGER) AS slot,
    COALESCE(a_count, 0) AS a_count, COALESCE(a_tons, 0) AS a_tons,
    COALESCE(b_count, 0) AS b_count, COALESCE(b_tons, 0) AS b_tons,
    COALESCE(fresh_tons, 0) AS fresh_tons, COALESCE(burnt_tons, 0) AS burnt_tons,
    COALESCE(a_count, 0) + COALESCE(b_count, 0) AS total_count,
    COALESCE(a_tons, 0) + COALESCE(b_tons, 0) AS total_tons
  FROM (SELECT DISTINCT report_date FROM sums) d
  CROSS JOIN range(24) g(slot)
  LEFT JOIN sums s ON s.report_date = d.report_date AND s.slot = g.slot)"""


EVENT_HOURS = f"{EVENT_TICKETS},\n{VALID},\n{hour_grid()}"
CLOCK_HOURS = f"{CLOCK_TICKETS},\n{VALID},\n{hour_grid()}"


def day(column="report_date"):
    return f"CAST({column} AS VARCHAR) AS {column.split('.')[-1]}"


def dbl(*columns):
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


def big(*columns):
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def txt(*columns):
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def r6(expression, name=None):
    return f"ROUND(CAST({expression} AS DOUBLE), 6) AS {name or expression}"


TALLY_OUT = (f"{big('a_count', 'b_count', 'total_count')}, "
             f"{dbl('a_tons', 'b_tons', 'fresh_tons', 'burnt_tons', 'total_tons')}")
TICKET_OUT = (f"{big('ticket_id')}, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, {day()}, {dbl('net_weight')}, "
              "prod_line, cane_type, print_q, print_w, lane_code, truck_q")

# Per-day record of the dashboard over `hours` and `valid`, with band joins for the spans.
DAY_RECORD = """day AS (
  SELECT report_date, CAST(SUM(total_tons) AS DOUBLE) AS tons,
    CAST(SUM(fresh_tons) AS DOUBLE) AS fresh_tons, CAST(SUM(burnt_tons) AS DOUBLE) AS burnt_tons,
    CAST(SUM(fresh_tons) + SUM(burnt_tons) AS DOUBLE) AS typed_tons,
    CAST(SUM(a_tons) AS DOUBLE) AS line_a_tons, CAST(SUM(b_tons) AS DOUBLE) AS line_b_tons,
    COUNT(*) FILTER (WHERE total_tons > 0) AS active_hours,
    COALESCE(CAST(MAX(total_tons) FILTER (WHERE total_tons > 0) AS DOUBLE), 0) AS peak_tons,
    MAX(slot) FILTER (WHERE total_tons > 0) AS latest_slot,
    SUM(total_count) AS trucks
  FROM hours GROUP BY report_date),
peaks AS (
  SELECT report_date, MIN(slot) AS peak_slot FROM (
    SELECT h.report_date, h.slot FROM hours h JOIN day d USING (report_date)
    WHERE h.total_tons > 0 AND CAST(h.total_tons AS DOUBLE) = d.peak_tons) GROUP BY report_date),
daily AS (
  SELECT report_date, SUM(net_weight) AS t,
    COALESCE(SUM(net_weight) FILTER (WHERE cane_type = '1'), 0) AS f
  FROM valid GROUP BY report_date),
back AS (
  SELECT d.report_date, d.report_date - x.report_date AS lag, x.t, x.f
  FROM day d JOIN daily x ON x.report_date BETWEEN d.report_date - 14 AND d.report_date - 1),
spans AS (
  SELECT report_date,
    COUNT(*) FILTER (WHERE lag <= 7) AS n1, COUNT(*) FILTER (WHERE lag > 7) AS n2, COUNT(*) AS n14,
    CAST(SUM(t) FILTER (WHERE lag <= 7) AS DOUBLE) AS t1, CAST(SUM(t) FILTER (WHERE lag > 7) AS DOUBLE) AS t2,
    CAST(SUM(f) FILTER (WHERE lag <= 7) AS DOUBLE) AS f1, CAST(SUM(f) FILTER (WHERE lag > 7) AS DOUBLE) AS f2,
    CAST(SUM(t) AS DOUBLE) AS t14
  FROM back GROUP BY report_date),
rec AS (
  SELECT d.*, p.peak_slot,
    CASE WHEN typed_tons > 0 THEN d.fresh_tons / typed_tons * 100 ELSE 0 END AS fresh_pct,
    COALESCE(s.n1, 0) > 0 AS has_baseline,
    CASE WHEN s.n1 > 0 THEN s.t1 / s.n1 ELSE 0 END AS avg_tons,
    CASE WHEN s.t1 > 0 THEN s.f1 / s.t1 * 100 ELSE 0 END AS avg_fresh_pct,
    COALESCE(s.n1 > 0 AND s.n2 > 0, FALSE) AS has_trend,
    CASE WHEN s.n1 > 0 AND s.n2 > 0 THEN
      CASE WHEN s.t2 / s.n2 > 0 THEN (s.t1 / s.n1 - s.t2 / s.n2) / (s.t2 / s.n2) * 100 ELSE 0 END
      ELSE 0 END AS tons_trend,
    CASE WHEN s.n1 > 0 AND s.n2 > 0 THEN
      (CASE WHEN s.t1 > 0 THEN s.f1 / s.t1 * 100 ELSE 0 END) - (CASE WHEN s.t2 > 0 THEN s.f2 / s.t2 * 100 ELSE 0 END)
      ELSE 0 END AS fresh_trend,
    CASE WHEN active_hours > 0 AND s.t14 > 0 THEN (d.tons / active_hours) / (s.t14 / s.n14 / 24) END AS performance_index
  FROM day d LEFT JOIN spans s USING (report_date) LEFT JOIN peaks p USING (report_date))"""

EVENT_DAYS = f"{EVENT_HOURS},\n{DAY_RECORD}"
CLOCK_DAYS = f"{CLOCK_HOURS},\n{DAY_RECORD}"
