"""Daily, monthly and season tallies."""

from pyspark.sql import functions as F

from weighyard import schema as S
from weighyard.functions.clock import slot_label
from weighyard.functions.guards import double, percent, ratio
from weighyard.functions.layers import add, aggregates, named
from weighyard.functions.predicates import date_range, keep, printed_ticket, rule
from weighyard.functions.text import month_key
from weighyard.operators.hourly import (
    IS_BURNT, IS_FRESH, ON_A, ON_B, WEIGHT, ZERO, count_where, tons_where,
)
from weighyard.plans.joins import settle

TYPE_TONS = {"fresh_tons": tons_where(IS_FRESH), "burnt_tons": tons_where(IS_BURNT)}
LINE_TONS = {"a_tons": tons_where(ON_A), "b_tons": tons_where(ON_B)}


def season_total(tickets, predicate="printed"):
    """The one-row grand total that a source may also offer as a view of its own."""
    return keep(tickets, predicate).agg(*aggregates({"season_tons": tons_where()}))


def season_totals(tickets, grand_total=None, predicate="valid"):
    """One row: tons by line and type, trucks by line, all trucks, and the grand total.

    Without a `grand_total` view all of it comes from one scan. A global aggregate is one
    row, so broadcasting the view's is bounded.
    """
    rows = tickets.where(f"({rule(predicate)}) OR ({printed_ticket()})").selectExpr(
        "prod_line", "cane_type", "net_weight",
        f"coalesce({rule(predicate)}, false) AS counts", f"coalesce({printed_ticket()}, false) AS printed")
    totals = rows.agg(*aggregates({
        "a_tons": tons_where(f"counts AND {ON_A}"), "b_tons": tons_where(f"counts AND {ON_B}"),
        "fresh_tons": tons_where(f"counts AND {IS_FRESH}"),
        "burnt_tons": tons_where(f"counts AND {IS_BURNT}"),
        "a_trucks": count_where(f"counts AND {ON_A}"), "b_trucks": count_where(f"counts AND {ON_B}"),
        "all_trucks": count_where("counts"), "season_tons": tons_where("printed"),
    }))
    if grand_total is None:
        return totals
    # max() over the view keeps it one row whatever the caller passes.
    one_row = grand_total.agg(*aggregates({"season_tons": "max(season_tons)"}))
    return totals.drop("season_tons").crossJoin(F.broadcast(one_row))


def daily_by_line(tickets, start=None, end=None, predicate="printed"):
    return keep(tickets, predicate, start, end).groupBy("report_date").agg(
        *aggregates({**LINE_TONS, "total_tons": tons_where()}))


def daily_weight(tickets, start=None, end=None, predicate="valid"):
    """Tons and trucks per day, tons by type and by line, whatever lines there are."""
    return keep(tickets, predicate, start, end).groupBy("report_date").agg(
        *aggregates({"tons": tons_where(), "trucks": "count(1)", **TYPE_TONS, **LINE_TONS}))


def daily_weight_summary(daily):
    """Number of days, total, mean, highest and lowest day of a daily_weight table."""
    return daily.agg(*aggregates({
        "days": "count(1)", "total": f"coalesce(sum(tons), {ZERO})",
        "max_tons": f"coalesce(max(tons), {ZERO})", "min_tons": f"coalesce(min(tons), {ZERO})",
    })).selectExpr("days", f"{double('total')} AS total_tons",
                   f"{ratio('total', 'days')} AS avg_tons", "max_tons", "min_tons")


def monthly(tickets, predicate="valid"):
    """Eight measures per calendar month of the report date."""
    return keep(tickets, predicate).groupBy(F.expr(month_key()).alias("month")).agg(*aggregates({
        "tons": tons_where(), **TYPE_TONS, **LINE_TONS, "trucks": "count(1)",
        "fresh_trucks": count_where(IS_FRESH), "burnt_trucks": count_where(IS_BURNT),
    }))


def _since(tickets, first_day, predicate):
    """No upper bound: tickets after the date of the question count too."""
    return keep(tickets, predicate).where(f"report_date >= {first_day}")


def season_trend(tickets, as_of, months=6, predicate="valid"):
    """Months since `as_of` minus six months; the mean is per ticket."""
    sums = _since(tickets, f"add_months(DATE'{as_of}', -{months})", predicate).groupBy(
        F.expr(month_key()).alias("month")
    ).agg(*aggregates({"tons": tons_where(), "tickets": "count(1)", **TYPE_TONS}))
    return add(sums, {"avg_ticket_tons": ratio("tons", "tickets")}).orderBy(F.desc("month"))


def ticket_stats(tickets, as_of, days=30, predicate="valid"):
    """Mean, sample deviation, lowest and highest ticket since `as_of` minus 30 days."""
    return _since(tickets, f"date_sub(DATE'{as_of}', {days})", predicate).agg(*aggregates({
        "tons": tons_where(), "tickets": "count(net_weight)",
        "std_tons": f"stddev_samp({double(WEIGHT)})",
        "min_tons": f"min({WEIGHT})", "max_tons": f"max({WEIGHT})",
    })).selectExpr("tickets", f"{ratio('tons', 'tickets')} AS avg_tons", "std_tons", "min_tons", "max_tons")


def fresh_trend(tickets, as_of, days=14, predicate="valid"):
    """Fresh share of the tons per day since `as_of` minus 14 days."""
    sums = _since(tickets, f"date_sub(DATE'{as_of}', {days})", predicate).groupBy("report_date").agg(
        *aggregates({"tons": tons_where(), "fresh_tons": tons_where(IS_FRESH)}))
    return sums.selectExpr(
        "report_date", f"{percent('fresh_tons', 'tons')} AS fresh_pct").orderBy("report_date")


def daily_training_agg(tickets, predicate="valid"):
    sums = keep(tickets, predicate).groupBy("report_date").agg(*aggregates({
        "tons": tons_where(), "trucks": "count(net_weight)",
        "fresh_trucks": count_where(IS_FRESH), "fresh_tons": tons_where(IS_FRESH),
    }))
    return add(sums, {"fresh_pct": percent("fresh_tons", "tons")})


def share_panel(tickets, predicate="valid"):
    """Today's type shares next to the season's shares of tons and trucks.

    Both levels come from the same daily sums, which are written to the checkpoint folder
    so that the tickets are scanned once; the season row is a global aggregate.
    """
    daily = settle(keep(tickets, predicate).groupBy("report_date").agg(*aggregates({
        "a_trucks": count_where(ON_A), "b_trucks": count_where(ON_B), **LINE_TONS, **TYPE_TONS})))
    names = ("a_tons", "b_tons", "a_trucks", "b_trucks", "fresh_tons", "burnt_tons")
    season = daily.agg(*aggregates({f"season_{n}": f"sum({n})" for n in names}))

    def share(one, other):
        return percent(one, f"({one} + {other})")

    return daily.crossJoin(F.broadcast(season)).selectExpr("report_date", *named({
        "fresh_pct": share("fresh_tons", "burnt_tons"),
        "burnt_pct": share("burnt_tons", "fresh_tons"),
        "season_a_tons_pct": share("season_a_tons", "season_b_tons"),
        "season_b_tons_pct": share("season_b_tons", "season_a_tons"),
        "season_a_trucks_pct": share("season_a_trucks", "season_b_trucks"),
        "season_b_trucks_pct": share("season_b_trucks", "season_a_trucks"),
        "season_fresh_pct": share("season_fresh_tons", "season_burnt_tons"),
        "season_burnt_pct": share("season_burnt_tons", "season_fresh_tons"),
    }))


def day_averages(frame):
    """Means over the fixed 24 hours of a day."""
    names = ("a_count", "b_count", "a_tons", "b_tons")
    sums = frame.groupBy("report_date").agg(*aggregates({n: f"sum({n})" for n in names}))
    return sums.selectExpr("report_date", *[f"{double(n)} / {S.SLOTS_PER_DAY} AS avg_{n}" for n in names])


# Aggregates over the 24 slots of a day; ties of the peak go to the earliest slot.
SUMMARY = {
    "active_hours": "count_if(total_tons > 0)",
    "day_tons": "sum(total_tons)",
    "peak": "max(IF(total_tons > 0, struct(total_tons AS tons, -slot AS minus_slot), NULL))",
    "latest": "max(IF(total_tons > 0, struct(slot, total_tons AS tons), NULL))",
}


def forecast_label(hours="active_hours"):
    """How far the run-rate forecast can be trusted; empty before the first ticket."""
    return (f"CASE WHEN {hours} <= 0 THEN '' WHEN {hours} < 6 THEN 'early' "
            f"WHEN {hours} < 12 THEN 'half_day' ELSE 'full_day' END")


# Columns over the aggregates of SUMMARY.
UNPACKED = {
    "peak_slot": "-peak.minus_slot",
    "peak_label": f"coalesce({slot_label('(-peak.minus_slot)')}, 'N/A')",
    "peak_tons": f"coalesce(peak.tons, {ZERO})",
    "latest_slot": "latest.slot",
    "latest_label": f"coalesce({slot_label('latest.slot')}, 'N/A')",
    "latest_tons": f"coalesce(latest.tons, {ZERO})",
    "forecast_tons": f"{ratio('day_tons', 'active_hours')} * 24",
    "forecast_label": forecast_label(),
}


def exec_summary(frame):
    """Active hours, peak hour, latest hour and the run-rate forecast per day."""
    sums = frame.groupBy("report_date").agg(*aggregates(SUMMARY))
    return sums.selectExpr("report_date", "active_hours", "day_tons", *named(UNPACKED))


def range_filter(tickets, start, end):
    return tickets.where(date_range(start, end))
