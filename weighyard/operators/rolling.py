"""Trailing windows over calendar days.

A window of at most 14 days is a bounded fan-out: every day is sent to each date that
looks back at it and the copies are summed there. That is one shuffle with partial
aggregation, it needs no global ordering, and no task ever holds the whole history.
"""

from datetime import date, timedelta

from weighyard.functions.guards import percent, percent_change, ratio
from weighyard.functions.layers import add, aggregates, named
from weighyard.functions.predicates import date_range, keep
from weighyard.operators.hourly import IS_FRESH, ZERO, tons_where
from weighyard.plans.joins import lookup_join

WEEK = (1, 7)
WEEK_BEFORE = (8, 14)
FORTNIGHT = (1, 14)


def scan_start(start, reach):
    """The first day to scan for answers from `start` on that look `reach` days back."""
    return None if start is None else date.fromisoformat(str(start)) - timedelta(days=reach)


def ticket_days(tickets, predicate="valid", start=None, end=None, reach=0):
    """Per day: tons, fresh tons, tickets. The only shuffle of ticket-derived rows.

    The range of answers becomes the range of the scan: the days before `start` that the windows look
    back at, and nothing after `end`. It is a condition on the raw date, so it prunes partitions.
    """
    return keep(tickets, predicate, scan_start(start, reach), end).where("report_date IS NOT NULL").groupBy("report_date").agg(*aggregates({
        "tons": tons_where(), "fresh_tons": tons_where(IS_FRESH), "tickets": "count(1)"}))


def trailing(daily, spans, sums=("tons", "fresh_tons"), carry=(), idle_days=False, data=None):
    """Sums over spans of previous days, for every date in one pass.

    `spans` maps a name to (nearest, farthest) days back; 0 is the day itself. For each
    span the result has <span>_days and <span>_<column> for the columns in `sums`.
    `carry` columns are passed through from the day itself. Dates without a row of their
    own appear only with `idle_days`. A day counts in a span if the boolean column `data`
    says so (default: every row).
    """
    reach = max(far for _, far in spans.values())
    wanted = dict.fromkeys((*sums, *carry, *([data] if data else [])))
    copies = daily.selectExpr(
        "report_date AS own_date", *wanted, f"explode(sequence(0, {reach})) AS lag",
    ).selectExpr("date_add(own_date, lag) AS report_date", "lag", *wanted)
    outputs = {"own_rows": "count_if(lag = 0)"}
    for name, (near, far) in spans.items():
        inside = f"lag BETWEEN {near} AND {far}" + (f" AND {data}" if data else "")
        outputs[f"{name}_days"] = f"count_if({inside})"
        outputs.update({f"{name}_{c}": f"sum(IF({inside}, {c}, NULL))" for c in sums})
    outputs.update({c: f"max(IF(lag = 0, {c}, NULL))" for c in carry})
    grouped = copies.groupBy("report_date").agg(*aggregates(outputs))
    if not idle_days:
        grouped = grouped.where("own_rows > 0")
    return grouped.drop("own_rows")


def baseline_columns(span="week"):
    """Mean tons per day with data and fresh share over one span."""
    return {
        "avg_daily_tons": ratio(f"{span}_tons", f"{span}_days"),
        "avg_fresh_percent": percent(f"{span}_fresh_tons", f"{span}_tons"),
        "has_comparison_data": f"{span}_days > 0",
    }


def _fresh_shift(now, before):
    return (f"{percent(f'{now}_fresh_tons', f'{now}_tons')}"
            f" - {percent(f'{before}_fresh_tons', f'{before}_tons')}")


def trend_columns(now="week", before="prior"):
    """Change of the mean per data-day and of the fresh share; both sides must have data."""
    both = f"({now}_days > 0 AND {before}_days > 0)"
    means = [ratio(f"{side}_tons", f"{side}_days") for side in (now, before)]
    return {
        "has_trend_data": both,
        "tons_trend_percent": f"IF({both}, {percent_change(*means)}, NULL)",
        "fresh_trend_percent": f"IF({both}, {_fresh_shift(now, before)}, NULL)",
    }


def baseline_7d(tickets, idle_days=False, start=None, end=None):
    """For every day, or those of a range: mean tons per data-day and fresh share of the seven days before."""
    days = ticket_days(tickets, start=start, end=end, reach=WEEK[1])
    spans = trailing(days, {"week": WEEK}, idle_days=idle_days).where(date_range(start, end))
    return spans.selectExpr("report_date", *named(baseline_columns()))


def trend_7v7(tickets, idle_days=False, start=None, end=None):
    """For every day, or those of a range: the seven days before against the seven before those."""
    days = ticket_days(tickets, start=start, end=end, reach=WEEK_BEFORE[1])
    spans = trailing(days, {"week": WEEK, "prior": WEEK_BEFORE}, idle_days=idle_days).where(date_range(start, end))
    return spans.selectExpr("report_date", *named(trend_columns()))


def index_column(tons, hours, span="fortnight"):
    """Tons per active hour against a 24th of the span's mean day; NULL without either."""
    mean_hour = f"({ratio(f'{span}_tons', f'{span}_days')} / 24)"
    return f"IF({hours} > 0 AND {mean_hour} > 0, CAST({tons} AS DOUBLE) / {hours} / {mean_hour}, NULL)"


def performance_index(frame):
    """Hourly rate of every day of an hour frame against its 14 previous days."""
    daily = frame.groupBy("report_date").agg(*aggregates({
        "tons": "sum(all_tons)", "line_tons": "sum(total_tons)",
        "active_hours": "count_if(total_tons > 0)", "has_tickets": "sum(all_count) > 0",
    }))
    spans = trailing(daily, {"fortnight": FORTNIGHT}, sums=("tons",),
                     carry=("line_tons", "active_hours"), data="has_tickets")
    return spans.selectExpr("report_date", "line_tons", "active_hours",
                            f"{index_column('line_tons', 'active_hours')} AS performance_index")


def rolling_baseline_columns(span="week", min_days=3):
    """The training variant: at least three data-days and some tons, else 0 and false."""
    enough = f"({span}_days >= {min_days} AND coalesce({span}_tons, {ZERO}) > 0)"
    return {
        "avg_daily_tons": f"IF({enough}, {ratio(f'{span}_tons', f'{span}_days')}, 0.0D)",
        "avg_fresh_percent": f"IF({enough}, {percent(f'{span}_fresh_tons', f'{span}_tons')}, 0.0D)",
        "has_comparison_data": enough,
    }


def rolling_trend_columns(now="week", before="prior"):
    """The training variant: change of the totals; 0 where a side has no day."""
    both = f"({now}_days > 0 AND {before}_days > 0)"
    return {
        "tons_trend_percent": f"IF({both}, {percent_change(f'{now}_tons', f'{before}_tons')}, 0.0D)",
        "fresh_trend_percent": f"IF({both}, {_fresh_shift(now, before)}, 0.0D)",
    }


def rolling_baseline(tickets, min_days=3, start=None, end=None):
    """Own sums and the training baseline of every day, or of those of a range."""
    days = ticket_days(tickets, start=start, end=end, reach=WEEK[1])
    spans = trailing(days, {"week": WEEK}, carry=("tons", "fresh_tons")).where(date_range(start, end))
    return spans.selectExpr(
        "report_date", "tons", "fresh_tons", f"{percent('fresh_tons', 'tons')} AS fresh_pct",
        *named(rolling_baseline_columns(min_days=min_days)))


def rolling_trend(tickets, start=None, end=None):
    """The training trend of every day, or of those of a range."""
    days = ticket_days(tickets, start=start, end=end, reach=WEEK_BEFORE[1])
    spans = trailing(days, {"week": WEEK, "prior": WEEK_BEFORE}).where(date_range(start, end))
    return spans.selectExpr("report_date", *named(rolling_trend_columns()))


def ticket_with_baseline(tickets, min_days=3, predicate="valid"):
    """Every valid ticket with its day's sums and rolling baseline."""
    days = rolling_baseline(tickets, min_days).withColumnsRenamed({
        "tons": "day_tons", "fresh_tons": "day_fresh_tons", "fresh_pct": "day_fresh_pct"})
    return lookup_join(keep(tickets, predicate), days, "report_date", how="left")


#: Base dates look back at 13 days before themselves.
FORTNIGHT_BACK = 13


def _tons_and_trucks(tickets, predicate, start=None, end=None):
    return keep(tickets, predicate, scan_start(start, FORTNIGHT_BACK), end).where("report_date IS NOT NULL").groupBy("report_date").agg(
        *aggregates({"tons": tons_where(), "trucks": "count(1)"}))


def week_compare_daily(tickets, base_date=None, predicate="printed"):
    """Day rows labelled current [D-6, D] or previous [D-13, D-7] for base dates D.

    Without `base_date` every day in the table is a base date; with it only the 14 days it needs are read.
    """
    fan = _tons_and_trucks(tickets, predicate, base_date, base_date).selectExpr(
        "*", "explode(sequence(0, 13)) AS lag",
    ).selectExpr("date_add(report_date, lag) AS base_date", "lag",
                 "struct(report_date, IF(lag <= 6, 'current', 'previous') AS period, tons, trucks) AS row")
    if base_date is not None:
        fan = fan.where(f"base_date = DATE'{base_date}'")
    # A base date gathers at most 14 rows.
    gathered = fan.groupBy("base_date").agg(*aggregates({
        "rows": "collect_list(row)", "own_rows": "count_if(lag = 0)"}))
    if base_date is None:
        gathered = gathered.where("own_rows > 0")
    return gathered.selectExpr("base_date", "inline(rows)")


def week_compare(tickets, predicate="printed", start=None, end=None):
    """For every day D, or those of a range: totals and means of [D-6, D] and [D-13, D-7] and their change."""
    spans = trailing(_tons_and_trucks(tickets, predicate, start, end),
                     {"current": (0, 6), "previous": (7, FORTNIGHT_BACK)}, sums=("tons",)).where(date_range(start, end))
    means = add(spans, {
        "current_avg": ratio("current_tons", "current_days"),
        "previous_avg": ratio("previous_tons", "previous_days"),
    })
    return means.selectExpr(
        "report_date AS base_date", f"coalesce(current_tons, {ZERO}) AS current_tons",
        f"coalesce(previous_tons, {ZERO}) AS previous_tons", "current_avg", "previous_avg",
        f"{percent_change('current_avg', 'previous_avg')} AS change_pct")
