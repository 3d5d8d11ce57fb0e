"""Short forecasts and the sanity clamp for model predictions."""

from weighyard.functions.codes import code_list
from weighyard.functions.guards import double, percent_change
from weighyard.functions.layers import add, named


def next_hour_forecast(frame, current_hour=None):
    """Forecast of the next slot from the last three, for every hour of every day.

    Mean of the three plus a third of their rise; the band is 1.96 sample deviations and
    does not go below 0. The first two slots have too little history.
    """
    day = "PARTITION BY report_date ORDER BY slot"
    tail = f"OVER ({day} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    tons = double("total_tons")
    rows = frame.selectExpr("report_date", "slot", *named({
        "known": f"count(1) {tail}",
        "moving_avg": f"CAST(sum(total_tons) {tail} AS DOUBLE) / 3",
        "trend": f"({tons} - lag({tons}, 2) OVER ({day})) / 3",
        "std_tons": f"stddev_samp({tons}) {tail}",
    })).where("known = 3")
    if current_hour is not None:
        rows = rows.where(f"slot = {current_hour}")
    return rows.selectExpr(
        "report_date", "slot AS current_hour", "slot + 1 AS prediction_hour", "moving_avg", "trend",
        "moving_avg + trend AS predicted_tons", "std_tons",
        "greatest(0.0D, predicted_tons - 1.96 * std_tons) AS lower",
        "predicted_tons + 1.96 * std_tons AS upper",
        "CASE WHEN std_tons < 10 THEN 'high' WHEN std_tons < 20 THEN 'medium' ELSE 'low' END AS confidence")


def clamp_prediction(df, tons="tons", fresh="fresh_pct",
                     predicted_tons="predicted_tons", predicted_fresh="predicted_fresh"):
    """Replace implausible predictions by today's value and word the change as codes.

    Tons outside 0.6 to 1.4 times today and fresh shares outside 0 to 100 are replaced.
    """
    odd_tons = f"({predicted_tons} < 0 OR {predicted_tons} > {tons} * 1.4D OR {predicted_tons} < {tons} * 0.6D)"
    odd_fresh = f"({predicted_fresh} < 0 OR {predicted_fresh} > 100)"
    return add(df.where(f"{tons} > 0"), {
        "clamped_tons": double(f"IF({odd_tons}, {tons}, {predicted_tons})"),
        "clamped_fresh": double(f"IF({odd_fresh}, {fresh}, {predicted_fresh})"),
        "adjusted": f"{odd_tons} OR {odd_fresh}",
        "tons_change_pct": f"greatest(-25.0D, least(25.0D, {percent_change('clamped_tons', tons)}))",
        "fresh_change": f"clamped_fresh - {double(fresh)}",
        "tons_outlook": "CASE WHEN abs(tons_change_pct) < 3 THEN 'steady' "
                        "WHEN tons_change_pct > 3 THEN 'up' ELSE 'down' END",
        "fresh_outlook": "CASE WHEN abs(fresh_change) < 1.5 THEN 'steady' "
                         "WHEN fresh_change > 1.5 THEN 'better' ELSE 'worse' END",
        "confidence": "IF(adjusted, 'medium', 'high')",
    })


def compare_with_prediction(df, tons="tons", fresh="fresh_pct", predicted_tons="predicted_tons",
                            predicted_fresh="predicted_fresh", good_probability="p_good"):
    """Codes for how a day turned out against its prediction, with what to do about it."""
    high_tons, high_fresh = f"{tons} > {predicted_tons} * 1.1D", f"{fresh} > {predicted_fresh} + 5"
    low_tons = f"NOT ({high_tons}) AND {tons} < {predicted_tons} * 0.9D"
    low_fresh = f"{fresh} < {predicted_fresh} - 5"
    unlikely = f"{good_probability} < 0.3"
    found = code_list(
        (high_tons, "TONS_ABOVE_PREDICTION"), (low_tons, "TONS_BELOW_PREDICTION"),
        (high_fresh, "FRESH_ABOVE_PREDICTION"), (low_fresh, "FRESH_BELOW_PREDICTION"),
        (f"{good_probability} > 0.8", "GOOD_DAY_LIKELY"), (unlikely, "GOOD_DAY_UNLIKELY"))
    todo = code_list((low_tons, "CHECK_TRANSPORT"), (low_fresh, "CHECK_BURNT_HANDLING"), (unlikely, "FIND_CAUSES"))
    return add(df, {
        "model_findings": f"IF(size({found}) > 0, {found}, array('NORMAL'))",
        "model_actions": f"IF(size({todo}) > 0, {todo}, array('KEEP_STANDARD'))",
    })


def trend_outlook(df, tons="tons", fresh="fresh_pct",
                  predicted_tons="predicted_tons", predicted_fresh="predicted_fresh"):
    """Direction of the next days and how sure it is, from a prediction."""
    q, s = "outlook_tons_pct", "outlook_fresh_pp"
    return add(df, {
        q: percent_change(predicted_tons, tons),
        s: f"{predicted_fresh} - {double(fresh)}",
        "outlook": f"CASE WHEN {q} > 5 AND {s} > 2 THEN 'up' WHEN {q} < -5 OR {s} < -2 THEN 'down' ELSE 'flat' END",
        "outlook_confidence": f"CASE WHEN abs({q}) < 5 AND abs({s}) < 2 THEN 'high' "
                              f"WHEN abs({q}) > 15 OR abs({s}) > 8 THEN 'low' ELSE 'medium' END",
    })
