"""The whole dashboard answer of every day: scorecard, hours, cumulative curves, means and shares.

All parts come from one table of 24 rows a day, which is settled once, so the tickets are scanned once.
"""

from pyspark.sql import functions as F

from weighyard import schema as S
from weighyard.functions.clock import slot_label
from weighyard.functions.guards import double, percent
from weighyard.functions.layers import aggregates, named
from weighyard.operators.hourly import TALLY, hour_frame
from weighyard.plans.joins import settle
from weighyard.plans.scorecard import analysed, day_records

#: Lines of the cumulative chart.
CURVES = ("a_tons", "b_tons", "fresh_tons", "burnt_tons")
_SUMS = ("a_count", "b_count", "a_tons", "b_tons", "fresh_tons", "burnt_tons")


def _share(one, other):
    return percent(one, f"({one} + {other})")


def day_panels(frame):
    """Per day of an hour frame: the hours and their running sums as arrays, 24-hour means, day and season shares."""
    hour = f"struct(slot, {slot_label()} AS time_label, {', '.join(TALLY)})"
    days = frame.groupBy("report_date").agg(*aggregates({
        # At most 24 members; the slot comes first, so the array is in the order of the day.
        "hours": f"array_sort(collect_list({hour}))", **{n: f"sum({n})" for n in _SUMS}}))
    season = frame.agg(*aggregates({f"season_{n}": f"sum({n})" for n in _SUMS}))
    zeros = ", ".join(f"CAST(0 AS DECIMAL(38,2)) AS {n}" for n in CURVES)
    added = ", ".join(f"CAST(last.{n} + h.{n} AS DECIMAL(38,2)) AS {n}" for n in CURVES)
    start = f"struct(CAST(-1 AS INT) AS slot, {zeros})"
    # The running sums of the curves, folded over the day's hours.
    curve = (f"slice(aggregate(hours, array({start}), (found, h) -> concat(found, transform(slice(found, -1, 1), "
             f"last -> struct(CAST(h.slot AS INT) AS slot, {added})))), 2, {S.SLOTS_PER_DAY})")
    return days.crossJoin(F.broadcast(season)).selectExpr("report_date", "hours", *named({
        "cumulative": curve,
        "means": "struct(" + ", ".join(f"{double(n)} / {S.SLOTS_PER_DAY} AS {n}" for n in _SUMS[:4]) + ")",
        "shares": f"struct({_share('fresh_tons', 'burnt_tons')} AS fresh_pct, {_share('burnt_tons', 'fresh_tons')} AS burnt_pct, "
                  f"{_share('a_tons', 'b_tons')} AS a_pct, {_share('b_tons', 'a_tons')} AS b_pct)",
        "season_figures": "struct(" + ", ".join(f"{double(f'season_{n}')} AS {n}" for n in _SUMS) + ", "
                  f"{_share('season_a_tons', 'season_b_tons')} AS a_tons_pct, "
                  f"{_share('season_a_count', 'season_b_count')} AS a_trucks_pct, "
                  f"{_share('season_fresh_tons', 'season_burnt_tons')} AS fresh_pct)",
    }))


def dashboard(tickets, as_of, as_of_hour=12, closed="left"):
    """One row per day: every column of the daily scorecard and the panels of `day_panels`."""
    frame = settle(hour_frame(tickets, closed=closed))
    card = analysed(day_records(frame), as_of, as_of_hour)
    return card.join(day_panels(frame), "report_date")


def dashboard_hours(board):
    """Long form: one row per day and slot with the tally and the running sums."""
    rows = board.selectExpr("report_date", "status", "inline(arrays_zip(hours, cumulative))")
    return rows.selectExpr("report_date", "status", "hours.*", *[f"cumulative.{n} AS cum_{n}" for n in CURVES])


def dashboard_days(board):
    """Flat form: headline figures, means and shares of every day."""
    means = [f"means.{n} AS mean_{n}" for n in _SUMS[:4]]
    shares = [f"shares.{n} AS share_{n}" for n in ("fresh_pct", "burnt_pct", "a_pct", "b_pct")]
    season = [f"season_figures.{n} AS season_{n}" for n in (*_SUMS, "a_tons_pct", "a_trucks_pct", "fresh_pct")]
    return board.selectExpr("report_date", "status", "persona", "tons", "avg_tons", "fresh_pct", "overall_score",
                            "peak_label", "forecast_tons", *means, *shares, *season)
