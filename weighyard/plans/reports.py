"""Report rows: nested structs ready to be written as JSON, one line per day."""

from weighyard.functions.codes import text_array
from weighyard.functions.guards import double
from weighyard.functions.layers import named
from weighyard.operators.hourstats import INSIGHTS, RECOMMENDATIONS, battery
from weighyard.plans.scorecard import FIRST_STEP, HEADLINE


def analysis_report(card):
    """The exported subset of a daily scorecard."""
    return card.selectExpr("report_date", *named({
        "summary": "struct(tons AS total_tons, trucks AS total_trucks, "
                   "fresh_pct AS fresh_percentage, burnt_pct AS burnt_percentage)",
        "analysis": f"struct({HEADLINE} AS status, overall_score AS score, {FIRST_STEP} AS recommendation)",
        "efficiency_metrics": "struct(volume_eff, volume_status, hourly_eff, hourly_status, "
                              "quality_eff, quality_status, stability_status)",
        "operational_insights": f"coalesce(insights, {text_array(())})",
        "predictions": "struct(projected_tons, warnings)",
    }))


def efficiency_report(frame, high=100, medium=50, low=20):
    """Executive summary, the statistics battery, findings and the 24 hours of every day."""
    return battery(frame, high, medium, low).selectExpr("report_date", *named({
        "executive_summary": f"struct({double('tons')} AS total_tons, trucks AS total_trucks, active_hours, "
                             "efficiency_ratio, overall_index AS overall_performance_index, "
                             "level AS performance_level)",
        "detailed_analysis": "struct("
            "struct(direction, strength, slope, r, p_value, change_pct) AS trend, "
            "struct(mean_tons, std_pop, var_pop, cv_pct, q25, q50, q75, iqr, stability, outlier_slots) AS variability, "
            "struct(q75 AS threshold, peak_slots, peak_runs, best_slot) AS peaks, "
            "struct(balance_ratio, balance, corr_a_b AS ab, corr_fresh_burnt AS fresh_burnt) AS correlation, "
            "struct(efficiency_score, consistency_score, productivity_score, balance_score) AS component_scores)",
        "insights": INSIGHTS,
        "recommendations": RECOMMENDATIONS,
        "hourly_breakdown": "hours",
    }))
