"""The day record and the daily scorecard: every rule for every day in one job."""

from datetime import date, timedelta

from weighyard.functions.clock import slot_label
from weighyard.functions.guards import double, percent
from weighyard.functions.layers import aggregates, named, replace
from weighyard.operators import advice as A
from weighyard.operators import rules as R
from weighyard.operators.daily import SUMMARY, UNPACKED
from weighyard.operators.hourly import hour_frame
from weighyard.operators.rolling import (
    FORTNIGHT, WEEK, WEEK_BEFORE, baseline_columns, index_column, trailing, trend_columns,
)

_DAY_SUMS = ("a_tons", "b_tons", "fresh_tons", "burnt_tons", "all_count", "all_tons", "total_count")


def day_records(frame):
    """One row per day of an hour frame with everything the rules read.

    The tickets were reduced to slots before; from there this is one grouping by day
    (no shuffle) and one shuffle of the day rows to the dates that look back at them.
    """
    daily = frame.groupBy("report_date").agg(
        *aggregates({**{n: f"sum({n})" for n in _DAY_SUMS}, **SUMMARY}))
    # Plain columns, not structs: Spark sums and carries them by hashing, without a sort.
    own = ("day_a", "day_b", "day_fresh", "day_burnt", "trucks", "day_tons", "active_hours",
           "day_peak", "peak_slot", "day_latest", "latest_slot")
    packed = daily.selectExpr("report_date", *named({
        "has_tickets": "all_count > 0", "tons": "all_tons", "fresh_tons": "fresh_tons",
        "day_a": "a_tons", "day_b": "b_tons", "day_fresh": "fresh_tons", "day_burnt": "burnt_tons",
        "trucks": "total_count", "day_tons": "day_tons", "active_hours": "CAST(active_hours AS INT)",
        "day_peak": UNPACKED["peak_tons"], "peak_slot": UNPACKED["peak_slot"],
        "day_latest": UNPACKED["latest_tons"], "latest_slot": UNPACKED["latest_slot"],
    }))
    spans = trailing(packed, {"week": WEEK, "prior": WEEK_BEFORE, "fortnight": FORTNIGHT},
                     carry=own, data="has_tickets")
    facts = spans.selectExpr("report_date", *named(baseline_columns()), *named(trend_columns()),
                             "fortnight_tons", "fortnight_days", *own)
    typed = "(day_fresh + day_burnt)"
    return facts.selectExpr("report_date", *named({
        "tons": double("day_tons"),
        "avg_tons": "avg_daily_tons",
        "fresh_pct": percent("day_fresh", typed), "burnt_pct": percent("day_burnt", typed),
        "avg_fresh_pct": "avg_fresh_percent", "has_baseline": "has_comparison_data",
        "line_a_tons": double("day_a"), "line_b_tons": double("day_b"),
        "fresh_tons": double("day_fresh"), "burnt_tons": double("day_burnt"),
        "trucks": "trucks", "active_hours": "active_hours",
        "peak_tons": double("day_peak"), "latest_tons": double("day_latest"),
        "peak_label": f"coalesce({slot_label('peak_slot')}, 'N/A')",
        "latest_label": f"coalesce({slot_label('latest_slot')}, 'N/A')",
        "forecast_tons": UNPACKED["forecast_tons"], "forecast_label": UNPACKED["forecast_label"],
        "performance_index": index_column("day_tons", "active_hours"),
        "has_trend": "has_trend_data",
        "tons_trend": "coalesce(tons_trend_percent, 0.0D)",
        "fresh_trend": "coalesce(fresh_trend_percent, 0.0D)",
    }))


def scored(days):
    """Scores, persona, calendar, patterns and efficiency added to day records."""
    for step in (R.day_scores, R.persona, R.calendar_context, R.day_status, R.flow_pattern,
                 R.patterns, R.efficiency_metrics):
        days = step(days)
    return days


# What only a full analysis shows.
GATED = (
    "quantity", "quality", "stability", "trend_score", "persona", "flow_pattern",
    "hourly_pattern", "quality_pattern", "anomaly_score", "signals",
    "volume_eff", "hourly_eff", "quality_eff", "peak_ratio", "volume_status", "hourly_status",
    "quality_status", "stability_status", "trend_direction", "quality_trend",
    "anomalies", "alerts", "insights", "warnings", "recommendations",
    "daily_target", "daily_progress", "remaining_target", "hourly_target", "hourly_rate",
    "hourly_progress", "quality_target", "quality_gap", "trend_target", "projected_tons",
    "practical", "actionable", "learning", "contextual", "proactive", "adaptive",
)


def analysed(days, as_of, as_of_hour=12, std_column=None):
    """All rules. Lists are arrays; a day without the full analysis keeps them NULL."""
    rich = R.time_context(R.analysis_mode(scored(days), as_of), as_of_hour)
    rich = R.anomalies(rich, std_column)
    for step in (R.alerts, R.insights, R.benchmarks, R.day_projection, R.overall_score):
        rich = step(rich)
    rich = A.advice(A.recommendations(rich, as_of_hour), as_of_hour)
    gates = {name: f"IF(status = 'full', {name}, NULL)" for name in GATED}
    return replace(rich, {**gates, "overall_score": "IF(status = 'full', overall_score, 0.0D)"})


def daily_scorecard(tickets, as_of, as_of_hour=12, start=None, end=None, closed="left"):
    """The whole dashboard of every day, straight from the tickets.

    With `start` and `end` days of the range without tickets are present as 'no_data'. The
    scan starts 14 days earlier, so that baselines and trends see what they need.
    """
    scanned = None if start is None else date.fromisoformat(str(start)) - timedelta(days=14)
    days = day_records(hour_frame(tickets, closed=closed, start=scanned, end=end))
    return analysed(days if start is None else days.where(f"report_date >= DATE'{start}'"), as_of, as_of_hour)


def flat_scorecard(card):
    """The scorecard with its lists joined to text, for tables without nested types."""
    def joined(column):
        return f"array_join({column}, ',')"

    return card.selectExpr(
        "report_date", "status", "mode", "tons", "avg_tons", "fresh_pct", "avg_fresh_pct",
        "active_hours", "peak_tons", "peak_label", "latest_label", "forecast_tons", "forecast_label",
        "tons_trend", "fresh_trend", "performance_index",
        "quantity", "quality", "stability", "persona", "flow_pattern", "season", "week_part",
        "anomaly_score", "volume_eff", "hourly_eff", "quality_eff", "overall_score",
        *named({
            "signals": joined("signals"), "anomalies": joined("anomalies.code"),
            "alerts": joined("alerts.code"), "insights": joined("insights"),
            "recommendations": joined("transform(recommendations, r -> concat(r.priority, ':', r.category))"),
        }))


# The headline code of a day: its persona, or why there is none.
HEADLINE = "coalesce(persona, upper(status))"
# The recommendation shown first; days around New Year have their own.
FIRST_STEP = "coalesce(holiday_context, IF(size(recommendations) > 0, recommendations[0].category, NULL))"
