"""Row-wise scoring and rules over the day records (see schema.DAY_COLUMNS).

Every rule is an expression; nothing here shuffles. T is the day's tons, V the average
day before, f and g the fresh share today and before, h the active hours. A missing
number counts as 0, a missing trend as no trend.
"""

from weighyard.functions.codes import code_list, collect_findings, finding, text_array
from weighyard.functions.guards import percent
from weighyard.functions.layers import add
from weighyard.operators.personas import PERSONAS, by_persona


def _number(name):
    return f"coalesce(CAST({name} AS DOUBLE), 0.0D)"


T, V = _number("tons"), _number("avg_tons")
FRESH, AVG_FRESH = _number("fresh_pct"), _number("avg_fresh_pct")
HOURS = "coalesce(CAST(active_hours AS INT), 0)"
PEAK = _number("peak_tons")
TREND_KNOWN = "coalesce(has_trend, false)"
TONS_TREND, FRESH_TREND = _number("tons_trend"), _number("fresh_trend")
MONTH, DAY = "month(report_date)", "dayofmonth(report_date)"

# Guarded ratios; NULL where a part is missing, so that no comparison holds.
VOLUME_CHANGE = f"(try_divide({T} - {V}, {V}) * 100)"
QUALITY_SHIFT = f"({FRESH} - {AVG_FRESH})"
PEAK_RATIO = f"IF({T} > 0 AND {HOURS} > 0, try_divide({PEAK}, {T} / {HOURS}), NULL)"
RATE_RATIO = f"IF({HOURS} > 0 AND {V} > 0, try_divide(({T} / {HOURS}), ({V} / 24)), NULL)"
QUALITY_RATIO = f"IF({AVG_FRESH} > 0, {FRESH} / {AVG_FRESH}, NULL)"


def _bands(value, *steps, default):
    """CASE over (comparison, result) pairs in order."""
    return "CASE " + " ".join(f"WHEN {value} {test} THEN {result}" for test, result in steps) + f" ELSE {default} END"


# --- scores, persona, calendar ------------------------------------------------------

def day_scores(days):
    """Quantity, quality and stability on 0 to 5; all 0 without tons."""
    quantity = _bands(VOLUME_CHANGE, ("> 15", 5), ("> 5", 4), ("< -20", 1), ("< -10", 2), default=3)
    quality = _bands(QUALITY_SHIFT, ("> 5", 5), ("> 2", 4), ("< -8", 1), ("< -4", 2), default=3)
    stability = _bands(PEAK_RATIO, ("< 1.3", 5), ("< 1.6", 4), ("< 2.5", 2), (">= 2.5", 1), default=3)
    return add(days, {
        "quantity": f"CASE WHEN {T} <= 0 THEN 0 WHEN {V} > 0 THEN {quantity} ELSE 3 END",
        "quality": f"CASE WHEN {T} <= 0 THEN 0 WHEN {AVG_FRESH} > 0 THEN {quality} ELSE 3 END",
        "stability": f"CASE WHEN {T} <= 0 THEN 0 ELSE {stability} END",
    })


def persona(days):
    """The persona by ordered rules; needs the scores."""
    fine = "quantity >= 3 AND quality >= 3"
    return add(days, {
        "trend_score": f"IF({TREND_KNOWN}, {_bands(TONS_TREND, ('> 5', 1), ('< -5', -1), default=0)}"
                       f" + {_bands(FRESH_TREND, ('> 2', 1), ('< -2', -1), default=0)}, 0)",
        "persona": f"""CASE
            WHEN {HOURS} > 1 AND {HOURS} < 8 AND (quantity < 3 OR quality < 3) THEN 'WEAK_START'
            WHEN quantity <= 2 AND quality <= 2 THEN 'CRITICAL'
            WHEN quantity >= 4 AND quality >= 4 AND stability >= 4 THEN 'EXCELLENT'
            WHEN trend_score <= -2 AND {fine} THEN 'CONCERNING_TREND'
            WHEN trend_score >= 2 AND {fine} THEN 'STABLE_RECOVERY'
            WHEN quantity >= 4 AND quality <= 2 THEN 'QUANTITY_PUSH'
            WHEN quantity <= 2 AND quality >= 4 THEN 'QUALITY_FOCUS'
            WHEN quantity >= 3 AND stability <= 2 THEN 'VOLATILE_PERFORMANCE'
            ELSE 'STEADY_PERFORMANCE' END""",
    })


def calendar_context(days):
    """Days around New Year, the closed days and the season flag."""
    return add(days, {
        "holiday_context": f"CASE WHEN {MONTH} = 12 AND {DAY} IN (29, 30) THEN 'PRE_HOLIDAY_PUSH' "
                           f"WHEN {MONTH} = 1 AND {DAY} IN (3, 4, 5) THEN 'POST_HOLIDAY_RESTART' END",
        "closed": f"({MONTH} = 12 AND {DAY} = 31) OR ({MONTH} = 1 AND {DAY} IN (1, 2))",
        "in_season": f"{MONTH} = 12 OR {MONTH} <= 4",
    })


def flow_pattern(days):
    """Clusters or gaps within a day; NULL below four active hours."""
    return add(days, {"flow_pattern": f"""CASE
        WHEN {HOURS} < 4 OR {T} = 0 THEN NULL
        WHEN {PEAK_RATIO} >= 2.5 THEN 'DENSE_CLUSTER' WHEN {PEAK_RATIO} >= 1.8 THEN 'CLUSTER'
        WHEN {V} > 0 AND {T} < {V} * ({HOURS} / 24) * 0.7D THEN 'GAPS' END"""})


def patterns(days):
    """Season, part of the week, hourly rate, quality, anomaly score and signals."""
    volume_gap, quality_gap = f"abs({T} - {V}) / {V}", f"abs({FRESH} - {AVG_FRESH}) / {AVG_FRESH}"
    running = f"({HOURS} > 0 AND {T} > 0)"
    factors = " + ".join([
        f"IF({V} > 0 AND {volume_gap} > 0.3, {volume_gap} * 0.4D, 0.0D)",
        f"IF({AVG_FRESH} > 0 AND {quality_gap} > 0.15, {quality_gap} * 0.3D, 0.0D)",
        f"IF({TREND_KNOWN} AND abs({TONS_TREND}) > 10, abs({TONS_TREND}) * 0.01D, 0.0D)",
        f"IF({TREND_KNOWN} AND abs({FRESH_TREND}) > 5, abs({FRESH_TREND}) * 0.02D, 0.0D)",
    ])
    return add(days, {
        "season": f"CASE WHEN {MONTH} IN (12, 1, 2) THEN 'peak_season' WHEN {MONTH} IN (3, 4) THEN 'late_season' "
                  "ELSE 'off_season' END",
        "week_part": "CASE WHEN weekday(report_date) IN (0, 1) THEN 'week_start' "
                     "WHEN weekday(report_date) IN (4, 5) THEN 'week_end' END",
        "hourly_pattern": f"CASE WHEN {running} AND {V} > 0 THEN "
                          + _bands(RATE_RATIO, ("> 1.5", "'high_efficiency'"), ("< 0.7", "'low_efficiency'"),
                                   default="'normal_efficiency'") + " END",
        "quality_pattern": f"CASE WHEN {AVG_FRESH} > 0 THEN "
                           + _bands(QUALITY_RATIO, ("> 1.1", "'improving'"), ("< 0.9", "'declining'"),
                                    default="'stable'") + " END",
        "anomaly_score": f"IF({running}, least(1.0D, {factors}), 0.0D)",
        "signals": code_list(
            ("anomaly_score > 0.7", "high_risk_alert"),
            ("anomaly_score > 0.4 AND anomaly_score <= 0.7", "moderate_risk_alert"),
            (f"season = 'late_season' AND quality_pattern = 'declining' AND {running}", "seasonal_quality_decline"),
            ("week_part = 'week_end' AND hourly_pattern = 'high_efficiency'", "weekend_push_pattern"),
        ),
    })


# --- anomalies, efficiency, alerts --------------------------------------------------

def anomalies(days, std_column=None):
    """Six families of anomaly codes; the deviation defaults to a fifth of the average."""
    std = f"{V} * 0.2D" if std_column is None else f"coalesce(CAST({std_column} AS DOUBLE), {V} * 0.2D)"
    z = f"IF({V} > 0 AND {std} > 0, try_divide(abs({T} - {V}), {std}), NULL)"
    a, b, fresh, burnt = (_number(c) for c in ("line_a_tons", "line_b_tons", "fresh_tons", "burnt_tons"))
    a_share = f"IF({a} > 0 AND {b} > 0, {percent(a, f'({a} + {b})')}, NULL)"
    fresh_share = f"IF({fresh} > 0 AND {burnt} > 0, {percent(fresh, f'({fresh} + {burnt})')}, NULL)"
    found = [
        (f"{z} > 2 AND {T} > {V}", "VOLUME_HIGH", z),
        (f"{z} > 2 AND {T} <= {V}", "VOLUME_LOW", z),
        (f"{AVG_FRESH} > 0 AND {QUALITY_SHIFT} > 10", "QUALITY_HIGH", QUALITY_SHIFT),
        (f"{AVG_FRESH} > 0 AND {QUALITY_SHIFT} < -10", "QUALITY_LOW", QUALITY_SHIFT),
        (f"{RATE_RATIO} > 1.5", "RATE_HIGH", RATE_RATIO),
        (f"{RATE_RATIO} < 0.5", "RATE_LOW", RATE_RATIO),
        (f"{PEAK} > 0 AND {PEAK_RATIO} > 2.5", "PEAK_HIGH", PEAK_RATIO),
        (f"{a_share} > 70", "LINE_A_HIGH", a_share),
        (f"{a_share} < 30", "LINE_B_HIGH", f"100 - {a_share}"),
        (f"{fresh_share} > 95", "FRESH_HIGH", fresh_share),
        (f"{fresh_share} < 50", "BURNT_HIGH", f"100 - {fresh_share}"),
    ]
    return add(days, {"anomalies": collect_findings(
        *[finding(f"{T} > 0 AND {condition}", code, value) for condition, code, value in found])})


def efficiency_metrics(days):
    """Ratios against the baseline with their status; NULL where a part is missing."""
    def status(value, high, low):
        return (f"CASE WHEN {T} <= 0 THEN 'none' WHEN {value} > {high} THEN 'high' "
                f"WHEN {value} > {low} THEN 'normal' WHEN {value} IS NOT NULL THEN 'low' END")

    def direction(value, edge):
        bands = _bands(value, (f"> {edge}", "'up'"), (f"< -{edge}", "'down'"), default="'flat'")
        return f"CASE WHEN {TREND_KNOWN} AND {T} > 0 THEN {bands} END"

    return add(days, {
        "volume_eff": f"CASE WHEN {T} <= 0 THEN 0.0D WHEN {V} > 0 THEN {T} / {V} * 100 END",
        "hourly_eff": f"IF({T} <= 0, 0.0D, {RATE_RATIO} * 100)",
        "quality_eff": f"IF({T} <= 0, 0.0D, {QUALITY_RATIO} * 100)",
        "peak_ratio": PEAK_RATIO,
        "volume_status": status("volume_eff", 110, 90),
        "hourly_status": status("hourly_eff", 120, 80),
        "quality_status": status("quality_eff", 105, 95),
        "stability_status": f"CASE WHEN {T} <= 0 THEN 'none' WHEN peak_ratio < 1.5 THEN 'stable' "
                            "WHEN peak_ratio < 2 THEN 'medium' WHEN peak_ratio IS NOT NULL THEN 'volatile' END",
        "trend_direction": direction(TONS_TREND, 2),
        "quality_trend": direction(FRESH_TREND, 1),
    })


# Alerts on running totals; they need only the day record itself.
_SHARE = f"IF({V} > 0, {T} / {V}, NULL)"
_VOLUME = f"CASE WHEN {T} <= 0 THEN 0.0D WHEN {V} > 0 THEN {T} / {V} * 100 END"
_VERY_LOW = f"coalesce({_SHARE} < 0.5 AND {HOURS} >= 6, false)"
BASE_ALERTS = (
    finding(_VERY_LOW, "VOLUME_VERY_LOW", f"{_SHARE} * 100", level="critical"),
    finding(f"NOT {_VERY_LOW} AND {_SHARE} < 0.7 AND {HOURS} >= 8", "VOLUME_LOW", f"{_SHARE} * 100", level="warning"),
    finding(f"{AVG_FRESH} > 0 AND {FRESH} < {AVG_FRESH} * 0.8D", "QUALITY_DROP", FRESH, level="warning"),
    finding(f"{_VOLUME} < 70", "EFFICIENCY_LOW", _VOLUME, level="critical"),
    finding(f"{TREND_KNOWN} AND {TONS_TREND} < -10", "TREND_DOWN", TONS_TREND, level="warning"),
    finding(f"{HOURS} <= 4 AND {T} < {V} * 0.2D", "SLOW_START", T, level="info"),
)
# Alerts on the patterns of the day; they need `patterns` and `efficiency_metrics`.
PATTERN_ALERTS = (
    finding("anomaly_score > 0.8", "ANOMALY_HIGH", "anomaly_score", level="critical"),
    finding("anomaly_score > 0.6 AND anomaly_score <= 0.8", "ANOMALY_MODERATE", "anomaly_score", level="warning"),
    finding("array_contains(signals, 'high_risk_alert')", "RISK_FORECAST", level="warning"),
    finding("array_contains(signals, 'seasonal_quality_decline')", "SEASON_QUALITY", level="info"),
    finding("volume_eff > 130", "EFFICIENCY_EXCELLENT", "volume_eff", level="success"),
    finding("season = 'late_season'", "LATE_SEASON", level="info"),
)


def base_alerts(days):
    return add(days, {"alerts": collect_findings(*BASE_ALERTS)})


def alerts(days):
    return add(days, {"alerts": collect_findings(*BASE_ALERTS, *PATTERN_ALERTS)})


# --- insights, benchmarks, projection -----------------------------------------------

def insights(days):
    """Insight codes in order, each once; none without tons."""
    risk = "array_contains(signals, 'high_risk_alert')"
    decline = "array_contains(signals, 'seasonal_quality_decline')"
    push = "array_contains(signals, 'weekend_push_pattern')"
    own = by_persona({name: codes for name, (_, codes, _) in PERSONAS.items()})
    more = code_list(
        # Two personas already say this in their own list.
        ("volume_eff > 110 AND persona <> 'EXCELLENT'", "VOLUME_ABOVE_TARGET"),
        ("quality_eff < 95 AND persona <> 'QUANTITY_PUSH'", "QUALITY_BELOW_STANDARD"),
        ("peak_ratio > 2", "UNEVEN_INTAKE"),
        ("anomaly_score > 0.6", "ANOMALY_DETECTED"),
        ("season = 'peak_season'", "PEAK_SEASON"),
        ("season = 'late_season'", "LATE_SEASON"),
        ("week_part = 'week_end'", "WEEK_END"),
        ("quality_pattern = 'declining'", "QUALITY_DECLINING"),
        ("quality_pattern = 'improving'", "QUALITY_IMPROVING"),
        (risk, "HIGH_RISK_AHEAD"),
        (f"NOT {risk} AND {decline}", "SEASONAL_DECLINE"),
        (f"NOT {risk} AND NOT {decline} AND {push}", "WEEKEND_PUSH"),
        ("volume_eff > 130", "VOLUME_VERY_HIGH"),
        ("volume_eff < 70", "VOLUME_VERY_LOW"),
        ("quality_eff > 110", "QUALITY_VERY_GOOD"),
        ("quality_eff < 85", "QUALITY_VERY_LOW"),
    )
    return add(days, {"insights": f"IF({T} > 0, array_distinct(concat({own}, {more})), {text_array(())})"})


def benchmarks(days):
    """Targets and gaps against the baseline; NULL where a part is missing."""
    timed = f"{V} > 0 AND {HOURS} > 0"
    return add(days, {
        "daily_target": f"IF({V} > 0, {V}, NULL)",
        "daily_progress": f"IF({V} > 0, {T} / {V} * 100, NULL)",
        "remaining_target": f"IF({V} > 0, greatest(0.0D, {V} - {T}), NULL)",
        "hourly_target": f"IF({timed}, {V} / 24, NULL)",
        "hourly_rate": f"IF({timed}, {T} / {HOURS}, NULL)",
        "hourly_progress": f"IF({timed}, {T} / {HOURS} / ({V} / 24) * 100, NULL)",
        "quality_target": f"IF({AVG_FRESH} > 0, {AVG_FRESH}, NULL)",
        "quality_gap": f"IF({AVG_FRESH} > 0, {QUALITY_SHIFT}, NULL)",
        "trend_target": f"IF({TREND_KNOWN}, {V} * (1 + {TONS_TREND} / 100), NULL)",
    })


def day_projection(days):
    """End-of-day projection between 4 and 24 hours, and two warnings."""
    return add(days, {
        "projected_tons": f"IF({T} > 0 AND {HOURS} > 4 AND {HOURS} < 24, {T} + {T} / {HOURS} * (24 - {HOURS}), NULL)",
        "warnings": code_list(
            (f"{T} > 0 AND quality_eff < 95", "QUALITY_TOMORROW"),
            (f"{T} > 0 AND {TREND_KNOWN} AND {TONS_TREND} < -5", "TREND_FALLING"),
        ),
    })


# --- time, gates, overall score -----------------------------------------------------

def day_part(hour):
    """Part of the day of a clock hour."""
    for name, first, after in (("morning", 6, 12), ("afternoon", 12, 17), ("evening", 17, 22)):
        if first <= hour < after:
            return name
    return "night"


URGENCY = {"morning": "moderate", "afternoon": "high", "evening": "moderate", "night": "low"}


def time_context(days, as_of_hour):
    """Part of the day at `as_of_hour` with its urgency; weekend and holiday season."""
    part = day_part(as_of_hour)
    return add(days, {
        "day_part": f"'{part}'", "urgency": f"'{URGENCY[part]}'",
        "weekday_name": "date_format(report_date, 'EEEE')",
        "is_weekend": "weekday(report_date) >= 5",
        "holiday_season": f"({MONTH} = 12 AND {DAY} >= 25) OR ({MONTH} = 1 AND {DAY} <= 5)",
    })


def day_status(days):
    """Which analysis a day gets; needs the calendar columns. The order matters."""
    return add(days, {"status": f"""CASE WHEN closed THEN 'holiday' WHEN {T} <= 0 THEN 'no_data'
        WHEN NOT in_season THEN 'off_season' WHEN NOT coalesce(has_baseline, false) THEN 'no_baseline'
        ELSE 'full' END"""})


def analysis_mode(days, as_of):
    return add(days, {"mode": f"IF(report_date < DATE'{as_of}', 'historical', 'current')"})


def overall_score(days):
    """Weighted scores, adjusted by the patterns, on 1 to 10."""
    base = "(quantity * 0.4D + quality * 0.4D + stability * 0.2D)"
    adjust = " + ".join([
        _bands("anomaly_score", ("> 0.7", "-1.5D"), ("> 0.4", "-0.5D"), ("< 0.2", "0.3D"), default="0.0D"),
        _bands("volume_eff", ("> 120", "0.5D"), ("< 80", "-0.5D"), default="0.0D"),
        _bands("quality_eff", ("> 105", "0.3D"), ("< 95", "-0.3D"), default="0.0D"),
        _bands("season", ("= 'peak_season'", "0.2D"), ("= 'late_season'", "-0.1D"), default="0.0D"),
    ])
    return add(days, {
        "overall_score": f"greatest(1.0D, least(10.0D, 2 + ({base} + ({adjust}) - 1) / 4 * 8))"})
