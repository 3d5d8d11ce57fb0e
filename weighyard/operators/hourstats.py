"""Statistics over the 24 slots of a day.

`battery` computes everything in one grouping of the hour frame; the operators below
pick their columns, and Catalyst drops the aggregates nobody asked for.
"""

from itertools import combinations

from weighyard.functions.clock import slot_label
from weighyard.functions.codes import collect_findings, explode_findings, finding
from weighyard.functions.guards import correlation, double, percent, percent_change, ratio
from weighyard.functions.layers import add, aggregates, named
from weighyard.functions.student import slope_p_value

SERIES = ("a_tons", "b_tons", "fresh_tons", "burnt_tons", "total_tons")
PAIRS = tuple((x, x) for x in SERIES) + tuple(combinations(SERIES, 2))


def _pair_name(x, y):
    return f"corr_{x.removesuffix('_tons')}_{y.removesuffix('_tons')}"


def _sums(high, medium, low):
    return {
        "n": "count(1)", "tons": "sum(total_tons)", "trucks": "sum(total_count)",
        "a_sum": "sum(a_tons)", "b_sum": "sum(b_tons)",
        "active_hours": "count_if(total_tons > 0)",
        "max_tons": "max(total_tons)", "min_tons": "min(total_tons)",
        "high_hours": f"count_if(total_tons >= {high})",
        "medium_hours": f"count_if(total_tons >= {medium} AND total_tons < {high})",
        "low_hours": f"count_if(total_tons >= {low} AND total_tons < {medium})",
        "idle_hours": f"count_if(total_tons < {low})",
    }


def _moments():
    tons, slot = double("total_tons"), double("slot")
    return {
        "raw_slope": f"regr_slope({tons}, {slot})", "intercept": f"regr_intercept({tons}, {slot})",
        "raw_r": correlation(tons, slot),
        "std_pop": f"stddev_pop({tons})", "var_pop": f"var_pop({tons})", "std_samp": f"stddev_samp({tons})",
        "quartiles": f"percentile({tons}, array(0.25, 0.5, 0.75))",
        "hours": "array_sort(collect_list(struct(slot, total_tons)))",
        "best": "max(struct(total_tons AS tons, -slot AS minus_slot))",
    }


def _correlations():
    return {_pair_name(x, y): correlation(double(x), double(y)) for x, y in PAIRS}


def _mean_of(rows, size):
    """Mean tons of a slice of the day's hours."""
    total = f"aggregate({rows}, CAST(0 AS DECIMAL(38,2)), (acc, h) -> CAST(acc + h.total_tons AS DECIMAL(38,2)))"
    return ratio(total, size)


def _slots(test):
    """The slots whose tons (t) pass the test."""
    return f"transform(filter(hours, h -> {test.replace('t ', double('h.total_tons') + ' ')}), h -> h.slot)"


# Runs of at least two neighbouring peak slots, each as the list of its slots: a run starts
# where the slot before is missing and the next is present, and ends the other way round;
# starts and ends pair up in order.
_RUNS = (
    "zip_with("
    "filter(peak_slots, s -> NOT array_contains(peak_slots, s - 1) AND array_contains(peak_slots, s + 1)), "
    "filter(peak_slots, s -> array_contains(peak_slots, s - 1) AND NOT array_contains(peak_slots, s + 1)), "
    "(a, b) -> sequence(a, b))"
)

_HALF = "CAST(n DIV 2 AS INT)"

# Layers of columns over the aggregates; each layer reads the ones before.
_BASIC = {
    "mean_tons": ratio("tons", "n"),
    "q25": "quartiles[0]", "q50": "quartiles[1]", "q75": "quartiles[2]",
    "slope": "coalesce(raw_slope, 0.0D)", "r": "coalesce(raw_r, 0.0D)",
    "p_value": slope_p_value("raw_r", "n"),
    "first_half_avg": _mean_of(f"slice(hours, 1, {_HALF})", _HALF),
    "second_half_avg": _mean_of(f"slice(hours, {_HALF} + 1, CAST(n AS INT) - {_HALF})", f"(n - {_HALF})"),
    "best_slot": "-best.minus_slot", "best_tons": "best.tons",
    "efficiency_ratio": "active_hours / 24.0D",
    "tons_per_truck": ratio("tons", "trucks"),
    "balance_ratio": ratio("a_sum", "b_sum"),
}
_SHAPE = {
    "iqr": "q75 - q25",
    "cv_pct": percent("std_pop", "mean_tons"),
    "change_pct": percent_change("second_half_avg", "first_half_avg"),
    "direction": "CASE WHEN slope > 0.5 THEN 'increasing' WHEN slope < -0.5 THEN 'decreasing' ELSE 'stable' END",
    "strength": "CASE WHEN abs(slope) <= 0.5 THEN 'weak' WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END",
    "balance": "IF(balance_ratio BETWEEN 0.8 AND 1.2, 'balanced', 'unbalanced')",
    "peak_slots": _slots("t >= q75"),
    "efficiency_score": "least(100.0D, efficiency_ratio * 100)",
    "consistency_score": "greatest(0.0D, least(100.0D, 100 - "
                         f"IF(mean_tons > 0, {percent('std_samp', 'mean_tons')}, 100.0D)))",
    "productivity_score": "least(100.0D, tons_per_truck / 10 * 100)",
    "balance_score": "IF(a_sum + b_sum = 0, 0.0D, "
                     f"greatest(0.0D, 100 - abs({ratio('a_sum', '(a_sum + b_sum)')} - 0.5) * 200))",
}
_LABELS = {
    "outlier_slots": _slots("t < q25 - 1.5 * iqr OR t > q75 + 1.5 * iqr"),
    "peak_runs": _RUNS,
    "stability": "CASE WHEN cv_pct < 20 THEN 'very_stable' WHEN cv_pct < 40 THEN 'stable' "
                 "WHEN cv_pct < 60 THEN 'moderate' ELSE 'unstable' END",
    "overall_index": "efficiency_score * 0.3 + consistency_score * 0.25 "
                     "+ productivity_score * 0.25 + balance_score * 0.2",
}
_LEVEL = {
    "level": "CASE WHEN overall_index >= 80 THEN 'excellent' WHEN overall_index >= 70 THEN 'good' "
             "WHEN overall_index >= 60 THEN 'fair' WHEN overall_index >= 50 THEN 'poor' ELSE 'very_poor' END",
}


def battery(frame, high=100, medium=50, low=20):
    """One wide row of statistics per day. Adds no shuffle to an hour frame."""
    wide = frame.groupBy("report_date").agg(
        *aggregates({**_sums(high, medium, low), **_moments(), **_correlations()}))
    for layer in (_BASIC, _SHAPE, _LABELS, _LEVEL):
        wide = add(wide, layer)
    return wide


def hourly_metrics(wide):
    return wide.selectExpr(
        "report_date", "tons", "trucks", "active_hours", f"{double('tons')} / 24 AS tons_per_hour",
        f"{ratio('tons', 'active_hours')} AS tons_per_active_hour", "tons_per_truck", "max_tons", "min_tons",
        "high_hours", "medium_hours", "low_hours", "idle_hours", "efficiency_ratio")


def hourly_trend(wide):
    """Least-squares line of tons on the slot; days with fewer than 3 rows are dropped."""
    return wide.where("n >= 3").select(
        "report_date", "direction", "strength", "slope", "intercept", "r", "p_value",
        "change_pct", "first_half_avg", "second_half_avg")


def hourly_variability(wide):
    """Population deviation, quartiles and the stability label."""
    return wide.where("n >= 2").select(
        "report_date", "mean_tons", "std_pop", "var_pop", "cv_pct",
        "q25", "q50", "q75", "iqr", "stability")


def hourly_outliers(wide):
    """Slots outside the quartile fences (1.5 times the interquartile range)."""
    return wide.selectExpr("report_date", "size(outlier_slots) AS outlier_count", "outlier_slots")


def peak_periods(wide):
    """Slots at or above the upper quartile and the best slot (ties: the earliest)."""
    return wide.where("n >= 3").selectExpr(
        "report_date", "q75 AS threshold", "size(peak_slots) AS peak_count", "peak_slots",
        f"{ratio('size(peak_slots)', 'n')} AS peak_ratio",
        "best_slot", f"{slot_label('best_slot')} AS best_label", "best_tons")


def peak_runs(wide):
    """One row per run of at least two neighbouring peak slots."""
    return wide.selectExpr("report_date", "explode(peak_runs) AS run").selectExpr(
        "report_date", "run[0] AS first_slot", "element_at(run, -1) AS last_slot", "size(run) AS length")


def hourly_correlation(wide):
    """Long form of the correlation matrix (each pair once); with a constant it is 0."""
    cells = ", ".join(
        f"named_struct('series', '{x}', 'other', '{y}', 'corr', coalesce({_pair_name(x, y)}, 0.0D))"
        for x, y in PAIRS)
    return wide.where("n >= 4").selectExpr("report_date", "balance_ratio", "balance", f"inline(array({cells}))")


def performance_index_hourly(wide):
    return wide.select("report_date", "efficiency_score", "consistency_score",
                       "productivity_score", "balance_score", "overall_index", "level")


# What the day's statistics say; a moderate stability is not mentioned.
INSIGHTS = collect_findings(
    finding("true", "ACTIVE_HOURS", "active_hours"),
    finding("tons > 0", "TONS_PER_HOUR", f"{double('tons')} / 24"),
    finding("true", "concat('TREND_', upper(direction))",
            "CASE direction WHEN 'increasing' THEN change_pct WHEN 'decreasing' THEN abs(change_pct) END"),
    finding("stability <> 'moderate'", "concat('STABILITY_', upper(stability))", "cv_pct"),
    finding("true", "BEST_HOUR", "best_tons"),
    finding("true", "concat('INDEX_', upper(level))", "overall_index"),
)
RECOMMENDATIONS = collect_findings(
    finding("efficiency_ratio < 0.5", "EFFICIENCY", "efficiency_ratio", priority="high"),
    finding("stability = 'unstable'", "STABILITY", "cv_pct", priority="medium"),
    finding("balance = 'unbalanced'", "BALANCE", "balance_ratio", priority="medium"),
    finding("size(peak_slots) < 6", "PEAK_PERFORMANCE", "size(peak_slots)", priority="low"),
)


def hourly_insights(wide):
    return explode_findings(wide, INSIGHTS)


def hourly_recommendations(wide):
    return explode_findings(wide, RECOMMENDATIONS)


def cumulative(frame):
    """Running tons over the day."""
    over = "OVER (PARTITION BY report_date ORDER BY slot ROWS UNBOUNDED PRECEDING)"
    names = ("a_tons", "b_tons", "fresh_tons", "burnt_tons")
    return frame.selectExpr("report_date", "slot", *[f"sum({n}) {over} AS cum_{n}" for n in names])


def moving_avg(frame):
    """Centred mean of three slots; NULL at both ends of the day."""
    over = "OVER (PARTITION BY report_date ORDER BY slot ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return frame.selectExpr(
        "report_date", "slot", "total_tons",
        f"IF(count(1) {over} = 3, CAST(sum(total_tons) {over} AS DOUBLE) / 3, NULL) AS moving_avg")


def range_comparison(wide):
    """One row over all days of the battery: means, best and worst day (ties: earliest)."""
    age = "datediff(DATE'1970-01-01', report_date)"
    return wide.agg(*aggregates({
        "days": "count(1)",
        "avg_index": "coalesce(avg(overall_index), 0.0D)",
        "avg_efficiency_ratio": "coalesce(avg(efficiency_ratio), 0.0D)",
        "best": f"max(struct(overall_index AS index, {age} AS age, report_date AS day))",
        "worst": f"min(struct(overall_index AS index, -{age} AS age, report_date AS day))",
    })).selectExpr("days", "avg_index", "avg_efficiency_ratio", *named({
        "best_day": "best.day", "best_index": "best.index",
        "worst_day": "worst.day", "worst_index": "worst.index",
    }))


def best_worst_day(wide):
    """The best and the worst day as two labelled rows."""
    rows = ", ".join(
        f"named_struct('kind', '{kind}', 'report_date', {kind}_day, 'overall_index', {kind}_index)"
        for kind in ("best", "worst"))
    return range_comparison(wide).selectExpr(f"inline(array({rows}))")
