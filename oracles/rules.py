"""The rule sheet over the day records."""

from oracles.base import CLOCK_DAYS, EVENT_DAYS, big, day, label, txt

S = {}

AS_OF, AS_OF_HOUR_PART = "1998-06-30", "afternoon"

# One stage per layer of rules; later stages read the columns of the earlier ones.
RULES = """q0 AS (
  SELECT *,
    CASE WHEN tons > 0 AND active_hours > 0 THEN peak_tons / (tons / active_hours) END AS peak_ratio,
    CASE WHEN active_hours > 0 AND avg_tons > 0 THEN (tons / active_hours) / (avg_tons / 24) END AS rate,
    CASE WHEN avg_tons > 0 THEN (tons - avg_tons) / avg_tons * 100 END AS dv,
    fresh_pct - avg_fresh_pct AS dq, month(report_date) AS mo, dayofmonth(report_date) AS dm,
    isodow(report_date) AS wd
  FROM rec),
q1 AS (
  SELECT *,
    CASE WHEN tons <= 0 THEN 0 WHEN dv > 15 THEN 5 WHEN dv > 5 THEN 4 WHEN dv < -20 THEN 1 WHEN dv < -10 THEN 2 ELSE 3 END AS quantity,
    CASE WHEN tons <= 0 THEN 0 WHEN avg_fresh_pct <= 0 THEN 3 WHEN dq > 5 THEN 5 WHEN dq > 2 THEN 4 WHEN dq < -8 THEN 1
      WHEN dq < -4 THEN 2 ELSE 3 END AS quality,
    CASE WHEN tons <= 0 THEN 0 WHEN peak_ratio < 1.3 THEN 5 WHEN peak_ratio < 1.6 THEN 4 WHEN peak_ratio < 2.5 THEN 2
      WHEN peak_ratio >= 2.5 THEN 1 ELSE 3 END AS stability,
    CASE WHEN has_trend THEN
      CASE WHEN tons_trend > 5 THEN 1 WHEN tons_trend < -5 THEN -1 ELSE 0 END +
      CASE WHEN fresh_trend > 2 THEN 1 WHEN fresh_trend < -2 THEN -1 ELSE 0 END ELSE 0 END AS trend_score,
    CASE WHEN mo = 12 AND dm IN (29, 30) THEN 'PRE_HOLIDAY_PUSH' WHEN mo = 1 AND dm IN (3, 4, 5) THEN 'POST_HOLIDAY_RESTART' END AS holiday_context,
    (mo = 12 AND dm = 31) OR (mo = 1 AND dm IN (1, 2)) AS closed,
    mo IN (12, 1, 2, 3, 4) AS in_season,
    CASE WHEN mo IN (12, 1, 2) THEN 'peak_season' WHEN mo IN (3, 4) THEN 'late_season' ELSE 'off_season' END AS season,
    CASE WHEN wd IN (1, 2) THEN 'week_start' WHEN wd IN (5, 6) THEN 'week_end' END AS week_part,
    CASE WHEN tons > 0 AND rate > 1.5 THEN 'high_efficiency' WHEN tons > 0 AND rate < 0.7 THEN 'low_efficiency'
      WHEN tons > 0 AND rate IS NOT NULL THEN 'normal_efficiency' END AS hourly_pattern,
    CASE WHEN avg_fresh_pct > 0 THEN CASE WHEN fresh_pct / avg_fresh_pct > 1.1 THEN 'improving'
      WHEN fresh_pct / avg_fresh_pct < 0.9 THEN 'declining' ELSE 'stable' END END AS quality_pattern,
    CASE WHEN tons > 0 AND active_hours > 0 THEN LEAST(1.0::DOUBLE,
      CASE WHEN avg_tons > 0 AND abs(tons - avg_tons) / avg_tons > 0.3 THEN abs(tons - avg_tons) / avg_tons * 0.4::DOUBLE ELSE 0 END
      + CASE WHEN avg_fresh_pct > 0 AND abs(fresh_pct - avg_fresh_pct) / avg_fresh_pct > 0.15
          THEN abs(fresh_pct - avg_fresh_pct) / avg_fresh_pct * 0.3::DOUBLE ELSE 0 END
      + CASE WHEN has_trend AND abs(tons_trend) > 10 THEN abs(tons_trend) * 0.01::DOUBLE ELSE 0 END
      + CASE WHEN has_trend AND abs(fresh_trend) > 5 THEN abs(fresh_trend) * 0.02::DOUBLE ELSE 0 END) ELSE 0 END AS anomaly_score,
    CASE WHEN tons <= 0 THEN 0 WHEN avg_tons > 0 THEN tons / avg_tons * 100 END AS volume_eff,
    CASE WHEN tons <= 0 THEN 0 ELSE rate * 100 END AS hourly_eff,
    CASE WHEN tons <= 0 THEN 0 WHEN avg_fresh_pct > 0 THEN fresh_pct / avg_fresh_pct * 100 END AS quality_eff
  FROM q0),
q2 AS (
  SELECT *,
    CASE WHEN active_hours > 1 AND active_hours < 8 AND (quantity < 3 OR quality < 3) THEN 'WEAK_START'
      WHEN quantity <= 2 AND quality <= 2 THEN 'CRITICAL'
      WHEN quantity >= 4 AND quality >= 4 AND stability >= 4 THEN 'EXCELLENT'
      WHEN trend_score <= -2 AND quantity >= 3 AND quality >= 3 THEN 'CONCERNING_TREND'
      WHEN trend_score >= 2 AND quantity >= 3 AND quality >= 3 THEN 'STABLE_RECOVERY'
      WHEN quantity >= 4 AND quality <= 2 THEN 'QUANTITY_PUSH'
      WHEN quantity <= 2 AND quality >= 4 THEN 'QUALITY_FOCUS'
      WHEN quantity >= 3 AND stability <= 2 THEN 'VOLATILE_PERFORMANCE'
      ELSE 'STEADY_PERFORMANCE' END AS persona,
    CASE WHEN closed THEN 'holiday' WHEN tons <= 0 THEN 'no_data' WHEN NOT in_season THEN 'off_season'
      WHEN NOT has_baseline THEN 'no_baseline' ELSE 'full' END AS status,
    CASE WHEN report_date < DATE '{as_of}' THEN 'historical' ELSE 'current' END AS mode,
    CASE WHEN active_hours >= 4 AND tons <> 0 THEN CASE WHEN peak_ratio >= 2.5 THEN 'DENSE_CLUSTER' WHEN peak_ratio >= 1.8 THEN 'CLUSTER'
      WHEN avg_tons > 0 AND tons < avg_tons * (active_hours / 24.0::DOUBLE) * 0.7::DOUBLE THEN 'GAPS' END END AS flow_pattern,
    anomaly_score > 0.7 AS s_high, anomaly_score > 0.4 AND anomaly_score <= 0.7 AS s_mid,
    COALESCE(season = 'late_season' AND quality_pattern = 'declining', FALSE) AS s_decline,
    COALESCE(week_part = 'week_end' AND hourly_pattern = 'high_efficiency', FALSE) AS s_push,
    CASE WHEN line_a_tons > 0 AND line_b_tons > 0 THEN line_a_tons / (line_a_tons + line_b_tons) * 100 END AS a_share,
    CASE WHEN fresh_tons > 0 AND burnt_tons > 0 THEN fresh_tons / (fresh_tons + burnt_tons) * 100 END AS f_share,
    CASE WHEN avg_tons > 0 THEN abs(tons - avg_tons) / (avg_tons * 0.2::DOUBLE) END AS z
  FROM q1),
q3 AS (
  SELECT *,
    concat_ws(',', CASE WHEN s_high THEN 'high_risk_alert' END, CASE WHEN s_mid THEN 'moderate_risk_alert' END,
      CASE WHEN s_decline THEN 'seasonal_quality_decline' END, CASE WHEN s_push THEN 'weekend_push_pattern' END) AS signals,
    GREATEST(1.0::DOUBLE, LEAST(10.0::DOUBLE, 2 + ((quantity * 0.4::DOUBLE + quality * 0.4::DOUBLE + stability * 0.2::DOUBLE
      + (CASE WHEN anomaly_score > 0.7 THEN -1.5 WHEN anomaly_score > 0.4 THEN -0.5 WHEN anomaly_score < 0.2 THEN 0.3 ELSE 0 END
      + CASE WHEN volume_eff > 120 THEN 0.5 WHEN volume_eff < 80 THEN -0.5 ELSE 0 END
      + CASE WHEN quality_eff > 105 THEN 0.3 WHEN quality_eff < 95 THEN -0.3 ELSE 0 END
      + CASE WHEN season = 'peak_season' THEN 0.2 WHEN season = 'late_season' THEN -0.1 ELSE 0 END)::DOUBLE - 1) / 4) * 8)) AS overall_score
  FROM q2)""".replace("{as_of}", AS_OF)
C = f"WITH {CLOCK_DAYS},\n{RULES}"

S["day_scores"] = f"{C} SELECT {day()}, {big('quantity', 'quality', 'stability')} FROM q3"
S["persona"] = f"{C} SELECT {day()}, {big('trend_score')}, persona FROM q3"
S["calendar_context"] = f"{C} SELECT {day()}, holiday_context, {txt('closed', 'in_season')} FROM q3"
S["day_status"] = f"{C} SELECT {day()}, status FROM q3"
S["analysis_mode"] = f"{C} SELECT {day()}, mode FROM q3"
S["flow_pattern"] = f"{C} SELECT {day()}, flow_pattern FROM q3"
S["patterns"] = f"""{C} SELECT {day()}, season, week_part, hourly_pattern, quality_pattern,
    ROUND(anomaly_score, 6) AS anomaly_score, signals FROM q3"""
S["overall_score"] = f"{C} SELECT {day()}, ROUND(overall_score, 6) AS overall_score FROM q3"
S["time_context"] = f"""{C} SELECT {day()}, 'afternoon' AS day_part, 'high' AS urgency, dayname(report_date) AS weekday_name,
    CAST(wd >= 6 AS VARCHAR) AS is_weekend,
    CAST((mo = 12 AND dm >= 25) OR (mo = 1 AND dm <= 5) AS VARCHAR) AS holiday_season FROM q3"""


def long_form(rows, columns=("code", "value")):
    """UNION ALL of (condition, value columns...) as one row per finding."""
    parts = []
    for condition, *values in rows:
        picked = ", ".join(f"{v} AS {c}" for v, c in zip(values, columns))
        parts.append(f"SELECT report_date, {picked} FROM q3 WHERE {condition}")
    return " UNION ALL ".join(parts)


ANOMALIES = [
    ("z > 2 AND tons > avg_tons", "'VOLUME_HIGH'", "z"), ("z > 2 AND tons <= avg_tons", "'VOLUME_LOW'", "z"),
    ("avg_fresh_pct > 0 AND dq > 10", "'QUALITY_HIGH'", "dq"), ("avg_fresh_pct > 0 AND dq < -10", "'QUALITY_LOW'", "dq"),
    ("rate > 1.5", "'RATE_HIGH'", "rate"), ("rate < 0.5", "'RATE_LOW'", "rate"),
    ("peak_ratio > 2.5", "'PEAK_HIGH'", "peak_ratio"),
    ("a_share > 70", "'LINE_A_HIGH'", "a_share"), ("a_share < 30", "'LINE_B_HIGH'", "100 - a_share"),
    ("f_share > 95", "'FRESH_HIGH'", "f_share"), ("f_share < 50", "'BURNT_HIGH'", "100 - f_share"),
]
ANOMALIES = [(f"tons > 0 AND {c}", k, v) for c, k, v in ANOMALIES]
_VL = "avg_tons > 0 AND tons / avg_tons < 0.5 AND active_hours >= 6"
ALERTS = [
    (_VL, "'critical'", "'VOLUME_VERY_LOW'", "tons / avg_tons * 100"),
    (f"NOT ({_VL}) AND avg_tons > 0 AND tons / avg_tons < 0.7 AND active_hours >= 8", "'warning'", "'VOLUME_LOW'", "tons / avg_tons * 100"),
    ("avg_fresh_pct > 0 AND fresh_pct < avg_fresh_pct * 0.8::DOUBLE", "'warning'", "'QUALITY_DROP'", "fresh_pct"),
    ("volume_eff < 70", "'critical'", "'EFFICIENCY_LOW'", "volume_eff"),
    ("has_trend AND tons_trend < -10", "'warning'", "'TREND_DOWN'", "tons_trend"),
    ("active_hours <= 4 AND tons < avg_tons * 0.2::DOUBLE", "'info'", "'SLOW_START'", "tons"),
    ("anomaly_score > 0.8", "'critical'", "'ANOMALY_HIGH'", "anomaly_score"),
    ("anomaly_score > 0.6 AND anomaly_score <= 0.8", "'warning'", "'ANOMALY_MODERATE'", "anomaly_score"),
    ("s_high", "'warning'", "'RISK_FORECAST'", "NULL::DOUBLE"), ("s_decline", "'info'", "'SEASON_QUALITY'", "NULL::DOUBLE"),
    ("volume_eff > 130", "'success'", "'EFFICIENCY_EXCELLENT'", "volume_eff"),
    ("season = 'late_season'", "'info'", "'LATE_SEASON'", "NULL::DOUBLE"),
]
S["anomalies"] = f"{C}, f AS ({long_form(ANOMALIES)}) SELECT {day()}, code, ROUND(value, 6) AS value FROM f"
S["alerts"] = f"""{C}, f AS ({long_form(ALERTS, ('level', 'code', 'value'))})
  SELECT {day()}, level, code, ROUND(value, 6) AS value FROM f"""


# The stream reads all files in one batch, so its alerts are those of the final day totals.
S["stream_alerts"] = f"""WITH {EVENT_DAYS},\n{RULES}, f AS ({long_form(ALERTS[:6], ('level', 'code', 'value'))})
  SELECT {day()}, level, code, ROUND(value, 6) AS value FROM f"""


def _status(value, high, low):
    return (f"CASE WHEN tons <= 0 THEN 'none' WHEN {value} > {high} THEN 'high' WHEN {value} > {low} THEN 'normal'"
            f" WHEN {value} IS NOT NULL THEN 'low' END")


def _dir(value, edge):
    return (f"CASE WHEN has_trend AND tons > 0 THEN CASE WHEN {value} > {edge} THEN 'up' WHEN {value} < -{edge} THEN 'down'"
            " ELSE 'flat' END END")


S["efficiency_metrics"] = f"""{C} SELECT {day()}, volume_eff, hourly_eff, quality_eff, peak_ratio,
    {_status('volume_eff', 110, 90)} AS volume_status, {_status('hourly_eff', 120, 80)} AS hourly_status,
    {_status('quality_eff', 105, 95)} AS quality_status,
    CASE WHEN tons <= 0 THEN 'none' WHEN peak_ratio < 1.5 THEN 'stable' WHEN peak_ratio < 2 THEN 'medium'
      WHEN peak_ratio IS NOT NULL THEN 'volatile' END AS stability_status,
    {_dir('tons_trend', 2)} AS trend_direction, {_dir('fresh_trend', 1)} AS quality_trend FROM q3"""
S["benchmarks"] = f"""{C} SELECT {day()}, CASE WHEN avg_tons > 0 THEN avg_tons END AS daily_target,
    CASE WHEN avg_tons > 0 THEN tons / avg_tons * 100 END AS daily_progress,
    CASE WHEN avg_tons > 0 THEN GREATEST(0, avg_tons - tons) END AS remaining_target,
    CASE WHEN avg_tons > 0 AND active_hours > 0 THEN avg_tons / 24 END AS hourly_target,
    CASE WHEN avg_tons > 0 AND active_hours > 0 THEN tons / active_hours END AS hourly_rate,
    CASE WHEN avg_tons > 0 AND active_hours > 0 THEN tons / active_hours / (avg_tons / 24) * 100 END AS hourly_progress,
    CASE WHEN avg_fresh_pct > 0 THEN avg_fresh_pct END AS quality_target,
    CASE WHEN avg_fresh_pct > 0 THEN dq END AS quality_gap,
    CASE WHEN has_trend THEN avg_tons * (1 + tons_trend / 100) END AS trend_target FROM q3"""
S["day_projection"] = f"""{C} SELECT {day()},
    CASE WHEN tons > 0 AND active_hours > 4 AND active_hours < 24 THEN tons + tons / active_hours * (24 - active_hours) END AS projected_tons,
    concat_ws(',', CASE WHEN tons > 0 AND quality_eff < 95 THEN 'QUALITY_TOMORROW' END,
      CASE WHEN tons > 0 AND has_trend AND tons_trend < -5 THEN 'TREND_FALLING' END) AS warnings FROM q3"""


def listing(*pairs):
    """Comma-joined codes in order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in pairs) + ")"


_OWN = """CASE persona
      WHEN 'CRITICAL' THEN 'INTAKE_FAR_BELOW,DELIVERY_STUCK,CHECK_MACHINES_AND_CREW'
      WHEN 'EXCELLENT' THEN 'ABOVE_TARGET,SMOOTH_TEAMWORK,MACHINES_AT_CAPACITY'
      WHEN 'QUANTITY_PUSH' THEN 'VOLUME_ON_TARGET,FRESH_SHARE_FALLING,BURNT_SHARE_RISING'
      WHEN 'QUALITY_FOCUS' THEN 'FRESH_ABOVE_AVERAGE,VOLUME_BELOW_TARGET,GOOD_YARD_QUALITY'
      WHEN 'VOLATILE_PERFORMANCE' THEN 'GOOD_BUT_UNEVEN,CROWDED_HOURS,IMPROVE_QUEUE'
      WHEN 'STABLE_RECOVERY' THEN 'BACK_TO_STANDARD,RECOVERING,FIXES_WORK'
      WHEN 'CONCERNING_TREND' THEN 'TREND_FALLING,SLOWING_DOWN,ANALYSE_DEEPER'
      WHEN 'STEADY_PERFORMANCE' THEN 'ON_STANDARD,PREDICTABLE,GOOD_TEAMWORK'
      WHEN 'WEAK_START' THEN 'SLOW_FIRST_HOURS,CAN_STILL_IMPROVE,PREPARE_FOR_RUSH' END"""
_MORE = listing(
    ("volume_eff > 110 AND persona <> 'EXCELLENT'", "VOLUME_ABOVE_TARGET"),
    ("quality_eff < 95 AND persona <> 'QUANTITY_PUSH'", "QUALITY_BELOW_STANDARD"),
    ("peak_ratio > 2", "UNEVEN_INTAKE"), ("anomaly_score > 0.6", "ANOMALY_DETECTED"),
    ("season = 'peak_season'", "PEAK_SEASON"), ("season = 'late_season'", "LATE_SEASON"),
    ("week_part = 'week_end'", "WEEK_END"),
    ("quality_pattern = 'declining'", "QUALITY_DECLINING"), ("quality_pattern = 'improving'", "QUALITY_IMPROVING"),
    ("s_high", "HIGH_RISK_AHEAD"), ("NOT s_high AND s_decline", "SEASONAL_DECLINE"),
    ("NOT s_high AND NOT s_decline AND s_push", "WEEKEND_PUSH"),
    ("volume_eff > 130", "VOLUME_VERY_HIGH"), ("volume_eff < 70", "VOLUME_VERY_LOW"),
    ("quality_eff > 110", "QUALITY_VERY_GOOD"), ("quality_eff < 85", "QUALITY_VERY_LOW"))
INSIGHTS = f"CASE WHEN tons > 0 THEN {_OWN} || CASE WHEN {_MORE} = '' THEN '' ELSE ',' || {_MORE} END ELSE '' END"
S["insights"] = f"{C} SELECT {day()}, {INSIGHTS} AS insights FROM q3"


def recommendations(part):
    urgent = "persona IN ('WEAK_START', 'CRITICAL')"
    timed = {
        "morning": [(urgent, "MORNING_EMERGENCY_MEETING"), (f"NOT ({urgent})", "MORNING_SET_TARGETS")],
        "afternoon": [("volume_eff < 90", "AFTERNOON_PUSH_TRANSPORT"),
                      ("NOT COALESCE(volume_eff < 90, FALSE)", "AFTERNOON_KEEP_STANDARD")],
        "evening": [("TRUE", "EVENING_REVIEW_AND_PLAN")], "night": [],
    }[part]
    timed = timed + [("tons < avg_tons * 0.8::DOUBLE", "FIND_CAUSES_FOR_TOMORROW"), ("fresh_pct < 80", "STRESS_QUALITY_CONTROL")]
    rows = [
        ("persona IN ('CRITICAL', 'QUALITY_FOCUS')", "high", "VOLUME", "", "CHECK_TRUCKS_UNDERWAY", 3),
        ("persona = 'QUANTITY_PUSH'", "high", "QUALITY", "", "REVIEW_INTAKE_CRITERIA", 3),
        ("persona = 'VOLATILE_PERFORMANCE'", "medium", "STABILITY", "", "STUDY_HOURLY_DATA", 3),
        ("persona NOT IN ('CRITICAL', 'QUALITY_FOCUS', 'QUANTITY_PUSH', 'VOLATILE_PERFORMANCE')", "low", "IMPROVE", "",
         "SHORT_TEAM_MEETING", 3),
        *[(f"mode = 'current' AND {c}", "medium", "TIME_ADVICE", k, "ADJUST_PLAN", 3) for c, k in timed],
        ("anomaly_score > 0.7", "critical", "RISK", "", "EMERGENCY_MEETING", 4),
        ("season = 'late_season'", "medium", "SEASON", "", "ESTIMATE_REMAINING", 4),
        ("quality_pattern = 'declining'", "high", "QUALITY_CONTROL", "", "FIND_QUALITY_CAUSES", 4),
        ("week_part = 'week_end'", "medium", "WEEKEND", "", "CHECK_WEEKEND_VOLUME", 4),
        ("volume_eff < 80", "high", "EFFICIENCY", "", "FIND_WEAK_POINTS", 4),
    ]
    return rows


_RECS = " UNION ALL ".join(
    f"""SELECT report_date, CASE WHEN mode = 'historical' AND '{p}' = 'critical' THEN 'medium' ELSE '{p}' END AS priority,
      '{cat}' AS category, {f"'{d}'" if d else 'NULL'} AS detail, CAST(mode = 'historical' AS VARCHAR) AS next_cycle,
      '{first}' AS first_action, CAST(CASE WHEN mode = 'historical' THEN 4 ELSE {n} END AS BIGINT) AS action_count
    FROM q3 WHERE {c}""" for c, p, cat, d, first, n in recommendations("afternoon"))
S["recommendations"] = f"{C}, f AS ({_RECS}) SELECT * REPLACE (CAST(report_date AS VARCHAR) AS report_date) FROM f"

_SHARE = "(CASE WHEN tons > 0 AND avg_tons > 0 THEN tons / avg_tons END)"
_DUE = "(active_hours / 24.0::DOUBLE * avg_tons)"


def advice(part):
    morning, afternoon, evening = (str(part == p).upper() for p in ("morning", "afternoon", "evening"))
    early, late = f"{morning} AND active_hours < 4", f"{afternoon} AND active_hours >= 8"
    behind = "tons < avg_tons * 0.8::DOUBLE"
    adaptive = [(c.removeprefix("mode = 'current' AND "), d)
                for c, _, cat, d, *_ in recommendations(part) if cat == "TIME_ADVICE"]
    return {
        "practical": listing(
            (f"{_SHARE} < 0.7", "IMPROVE_TRANSPORT_AND_QUEUE"), (f"{_SHARE} > 1.3", "KEEP_HIGH_EFFICIENCY"),
            (early, "MORNING_PREPARATION"), (late, "AFTERNOON_CATCH_UP"), (evening, "EVENING_LESSONS"),
            ("persona = 'VOLATILE_PERFORMANCE'", "QUEUE_AGAINST_SWINGS"),
            ("persona = 'QUALITY_FOCUS'", "KEEP_QUALITY_RAISE_VOLUME"), ("persona = 'QUANTITY_PUSH'", "IMPROVE_INTAKE_CHECKS")),
        "actionable": listing(
            (behind, "MEET_TRANSPORT_TEAM"), (behind, "CHECK_MISSING_TRUCKS"), (morning, "SET_TARGETS"), (morning, "CHECK_MACHINES"),
            (f"{afternoon} AND tons < avg_tons * 0.6::DOUBLE", "PUSH_TRANSPORT"),
            (f"{afternoon} AND NOT (tons < avg_tons * 0.6::DOUBLE)", "KEEP_STANDARD"), (evening, "SUMMARISE_AND_PLAN"),
            ("persona = 'CRITICAL'", "CALL_TEAM_NOW"), ("persona = 'EXCELLENT'", "RECORD_SUCCESS"),
            ("persona = 'WEAK_START'", "PREPARE_FOR_RISE")),
        "learning": listing(
            (f"{_SHARE} < 0.7", "TRANSPORT_PLANNING_FAILED"), (f"{_SHARE} > 1.3", "RECORD_SUCCESS_FACTORS"),
            ("anomaly_score > 0.7", "DETECT_EARLY"), ("persona = 'VOLATILE_PERFORMANCE'", "EVEN_INTAKE_IS_HARD"),
            ("persona = 'QUALITY_FOCUS'", "QUALITY_WITH_VOLUME"), ("persona = 'STABLE_RECOVERY'", "SYSTEMATIC_FIXES")),
        "contextual": listing(
            (f"{early} AND tons < avg_tons * 0.2::DOUBLE", "SLOW_MORNING"), (f"{early} AND NOT (tons < avg_tons * 0.2::DOUBLE)", "GOOD_MORNING"),
            (f"{late} AND tons < {_DUE} * 0.8::DOUBLE", "AFTERNOON_BEHIND"), (f"{late} AND tons > {_DUE} * 1.2::DOUBLE", "AFTERNOON_AHEAD"),
            (f"{evening} AND active_hours >= 16", "DAY_NEARLY_DONE"),
            ("tons > avg_tons * 1.2::DOUBLE", "VOLUME_ABOVE_TARGET"), ("fresh_pct < 80", "FRESH_BELOW_STANDARD")),
        "proactive": listing(
            (behind, "FIND_CAUSES_FOR_TOMORROW"), ("active_hours >= 12 AND tons < avg_tons * 0.9::DOUBLE", "PLAN_COMPENSATION"),
            ("fresh_pct < 80", "IMPROVE_QUALITY_PROCESS")),
        "adaptive": listing(*adaptive),
    }


for _part in ("morning", "afternoon", "evening"):
    _cols = ", ".join(f"{sql} AS {name}" for name, sql in advice(_part).items())
    S[f"advice_{_part}"] = f"{C} SELECT {day()}, {_cols} FROM q3"

S["persona_profile"] = f"""{C} SELECT {day()}, persona,
    CASE persona WHEN 'CRITICAL' THEN 'danger' WHEN 'EXCELLENT' THEN 'success' WHEN 'STABLE_RECOVERY' THEN 'success'
      WHEN 'QUALITY_FOCUS' THEN 'primary' WHEN 'VOLATILE_PERFORMANCE' THEN 'info' WHEN 'STEADY_PERFORMANCE' THEN 'info'
      ELSE 'warning' END AS tone,
    CASE persona WHEN 'CRITICAL' THEN 'critical' WHEN 'EXCELLENT' THEN 'low' END AS priority,
    CASE persona WHEN 'CRITICAL' THEN 'high' WHEN 'EXCELLENT' THEN 'minimal' END AS risk_level,
    CASE persona WHEN 'CRITICAL' THEN 'immediate' WHEN 'EXCELLENT' THEN 'normal' END AS response_time,
    {_OWN} AS insights FROM q3"""

# --- scorecard -------------------------------------------------------------------------
_ALERT_CODES = listing(*[(c, k.strip("'")) for c, _, k, _ in ALERTS])
_ANOMALY_CODES = listing(*[(c, k.strip("'")) for c, k, _ in ANOMALIES])
_REC_CODES = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} THEN CASE WHEN mode = 'historical' AND '{p}' = 'critical' THEN 'medium' ELSE '{p}' END || ':{cat}' END"
    for c, p, cat, *_ in recommendations("afternoon")) + ")"
_GATED = ["flow_pattern", "anomaly_score", "volume_eff", "hourly_eff", "quality_eff", "persona"]


def scorecard(days):
    gate = "CASE WHEN status = 'full' THEN {} END AS {}"
    label = ("lpad(CAST(({0} + 18) % 24 AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(({0} + 19) % 24 AS VARCHAR), 2, '0') || ':00'")
    cols = [
        day(), "status", "mode", "tons", "avg_tons", "fresh_pct", "avg_fresh_pct", big("active_hours"), "peak_tons",
        f"COALESCE({label.format('peak_slot')}, 'N/A') AS peak_label",
        f"COALESCE({label.format('latest_slot')}, 'N/A') AS latest_label",
        "CASE WHEN active_hours > 0 THEN tons / active_hours * 24 ELSE 0 END AS forecast_tons",
        "CASE WHEN active_hours <= 0 THEN '' WHEN active_hours < 6 THEN 'early' WHEN active_hours < 12 THEN 'half_day' ELSE 'full_day' END AS forecast_label",
        "tons_trend", "fresh_trend", "performance_index", "season", "week_part",
        *[gate.format(f"CAST({c} AS BIGINT)", c) for c in ("quantity", "quality", "stability")],
        *[gate.format(f"ROUND({c}, 6)" if c == "anomaly_score" else c, c) for c in _GATED],
        "CASE WHEN status = 'full' THEN ROUND(overall_score, 6) ELSE 0 END AS overall_score",
        gate.format("signals", "signals"), gate.format(_ANOMALY_CODES, "anomalies"), gate.format(_ALERT_CODES, "alerts"),
        gate.format(INSIGHTS, "insights"), gate.format(_REC_CODES, "recommendations"),
    ]
    return f"WITH {days},\n{RULES} SELECT {', '.join(cols)} FROM q3"


S["daily_scorecard"] = scorecard(EVENT_DAYS)
S["daily_scorecard_history"] = scorecard(CLOCK_DAYS)
S["analysis_report"] = f"""WITH {CLOCK_DAYS},\n{RULES} SELECT {day()}, tons AS total_tons, {big('trucks')}, fresh_pct,
    CASE WHEN status = 'full' THEN persona ELSE upper(status) END AS headline,
    CASE WHEN status = 'full' THEN ROUND(overall_score, 6) ELSE 0 END AS score,
    CASE WHEN status = 'full' THEN volume_eff END AS volume_eff,
    CASE WHEN status = 'full' THEN {INSIGHTS} ELSE '' END AS operational_insights,
    CASE WHEN status = 'full' AND tons > 0 AND active_hours > 4 AND active_hours < 24
      THEN tons + tons / active_hours * (24 - active_hours) END AS projected_tons FROM q3"""

S["stream_alert_table"] = S["stream_alerts"]

# --- the dashboard in long and flat form ---------------------------------------------------
_MEANS = ("a_count", "b_count", "a_tons", "b_tons")
_SEASON = "a_count b_count a_tons b_tons fresh_tons burnt_tons".split()


def _part(one, both, name):
    return f"CASE WHEN {both} > 0 THEN CAST({one} AS DOUBLE) / CAST({both} AS DOUBLE) * 100 ELSE 0 END AS {name}"


S["dashboard_hours"] = f"""WITH {EVENT_DAYS},\n{RULES} SELECT {day('h.report_date')}, status, {big('h.slot').replace('AS h.slot', 'AS slot')},
    {label('h.slot')} AS time_label, {', '.join(f"CAST(h.{c} AS BIGINT) AS {c}" for c in ('a_count', 'b_count', 'total_count'))},
    {', '.join(f"CAST(h.{c} AS DOUBLE) AS {c}" for c in ('a_tons', 'b_tons', 'fresh_tons', 'burnt_tons', 'total_tons'))},
    {', '.join(f"CAST(SUM(h.{c}) OVER (PARTITION BY h.report_date ORDER BY h.slot) AS DOUBLE) AS cum_{c}"
               for c in ('a_tons', 'b_tons', 'fresh_tons', 'burnt_tons'))}
  FROM hours h JOIN q3 ON q3.report_date = h.report_date"""
S["dashboard_days"] = f"""WITH {EVENT_DAYS},\n{RULES}, own AS (
    SELECT report_date, {', '.join(f'SUM({c}) AS {c}' for c in _SEASON)} FROM hours GROUP BY report_date),
  all_days AS (SELECT {', '.join(f'SUM({c}) AS s_{c}' for c in _SEASON)} FROM hours)
  SELECT {day('q3.report_date')}, status, CASE WHEN status = 'full' THEN persona END AS persona, tons, avg_tons, fresh_pct,
    CASE WHEN status = 'full' THEN ROUND(overall_score, 6) ELSE 0 END AS overall_score,
    COALESCE({label('peak_slot')}, 'N/A') AS peak_label,
    CASE WHEN active_hours > 0 THEN tons / active_hours * 24 ELSE 0 END AS forecast_tons,
    {', '.join(f'CAST(own.{c} AS DOUBLE) / 24 AS mean_{c}' for c in _MEANS)},
    {_part('own.fresh_tons', '(own.fresh_tons + own.burnt_tons)', 'share_fresh_pct')},
    {_part('own.burnt_tons', '(own.fresh_tons + own.burnt_tons)', 'share_burnt_pct')},
    {_part('own.a_tons', '(own.a_tons + own.b_tons)', 'share_a_pct')}, {_part('own.b_tons', '(own.a_tons + own.b_tons)', 'share_b_pct')},
    {', '.join(f'CAST(s_{c} AS DOUBLE) AS season_{c}' for c in _SEASON)},
    {_part('s_a_tons', '(s_a_tons + s_b_tons)', 'season_a_tons_pct')},
    {_part('s_a_count', '(s_a_count + s_b_count)', 'season_a_trucks_pct')},
    {_part('s_fresh_tons', '(s_fresh_tons + s_burnt_tons)', 'season_fresh_pct')}
  FROM q3 JOIN own ON own.report_date = q3.report_date, all_days"""

STATEMENTS = S
