"""Day-level training records and the model's feature columns."""

from pyspark.sql import functions as F

from weighyard.functions.guards import double, percent, ratio
from weighyard.functions.layers import add, aggregates, named
from weighyard.functions.predicates import keep
from weighyard.operators.hourly import IS_FRESH, WEIGHT, tons_where
from weighyard.operators.rolling import (
    WEEK, WEEK_BEFORE, rolling_baseline_columns, rolling_trend_columns, trailing,
)
from weighyard.operators.rules import day_scores
from weighyard.plans.joins import settle

FEATURES = (
    "tons", "avg_tons", "fresh_pct", "avg_fresh_pct", "active_hours", "peak_tons",
    "tons_trend", "fresh_trend", "quantity_ratio", "quality_ratio", "peak_share",
    "abs_tons_trend", "abs_fresh_trend", "in_season_flag",
)


# Order of the tickets within a clock hour, by time and then by ticket, as one decimal: micros
# into the hour, then the whole id, negative ones included. Tickets without an id come before
# all others and are told apart by their weight. A struct would do the same, but Spark
# aggregates structs by sorting all tickets, and plain numbers by hashing. The time zone
# used for the fraction does not matter: zones differ by whole seconds.
_STEP, _ABOVE_WEIGHTS = 3 * 10 ** 19, 2 * 10 ** 18 + 2 ** 63
_MICROS = ("(minute(ts) * 60 + second(ts)) * 1000000L"
           " + pmod(unix_micros(CAST(ts AS TIMESTAMP)), 1000000L)")
_ORDER = (f"CAST({_MICROS} AS DECIMAL(10,0)) * CAST('{_STEP}' AS DECIMAL(20,0)) + coalesce("
          f"CAST(ticket_id AS DECIMAL(20,0)) + CAST('{_ABOVE_WEIGHTS}' AS DECIMAL(20,0)), "
          f"CAST(greatest({WEIGHT} * 100, 0) AS DECIMAL(20,0)), 0)")


def training_days(tickets, start=None, end=None, min_days=3):
    """Per-day statistics with rolling baseline, trend and scores, from clock hours."""
    by_hour = keep(tickets, "valid", start, end).where("report_date IS NOT NULL").groupBy(
        "report_date", F.expr("hour(ts)").alias("clock_hour")
    ).agg(*aggregates({
        "tons": tons_where(), "fresh_tons": tons_where(IS_FRESH), "tickets": "count(1)",
        "latest_ts": "max(ts)", "latest_tons": f"max_by({WEIGHT}, {_ORDER})",
    }))
    own = {
        "day_tons": "sum(tons)", "day_fresh": "sum(fresh_tons)", "tickets": "sum(tickets)",
        "active_hours": "count_if(clock_hour IS NOT NULL)",  # a ticket without a time is in the day only
        # Ties of the peak go to the earliest hour.
        "peak": "max(IF(clock_hour IS NULL, NULL, struct(tons, -clock_hour AS minus_hour)))",
        "latest": "max(struct(latest_ts AS ts, latest_tons AS tons))",
    }
    daily = by_hour.groupBy("report_date").agg(*aggregates(own))
    packed = daily.selectExpr("report_date", f"struct({', '.join(own)}) AS own",
                              "day_tons AS tons", "day_fresh AS fresh_tons")
    spans = trailing(packed, {"week": WEEK, "prior": WEEK_BEFORE}, carry=("own",))
    days = spans.selectExpr(
        "report_date", *named(rolling_baseline_columns(min_days=min_days)), *named(rolling_trend_columns()),
        "inline(array(own))",
    ).selectExpr("report_date", *named({
        "tons": double("day_tons"), "avg_tons": "avg_daily_tons",
        "fresh_pct": percent("day_fresh", "day_tons"), "avg_fresh_pct": "avg_fresh_percent",
        "has_baseline": "has_comparison_data",
        "active_hours": "CAST(active_hours AS INT)",
        "peak_tons": double("peak.tons"), "peak_hour": "-peak.minus_hour",
        "latest_ts": "latest.ts", "latest_tons": double("latest.tons"), "tickets": "tickets",
        "has_trend": "true", "tons_trend": "tons_trend_percent", "fresh_trend": "fresh_trend_percent",
    }))
    return day_scores(days)


def training_records(tickets, start=None, end=None, min_days=3):
    """The days that have a baseline."""
    return training_days(tickets, start, end, min_days).where("has_baseline")


def ml_features(days):
    """Fourteen feature columns; a ratio without a basis is 1. The season is the row's own."""
    mean_hour = "IF(active_hours > 0 AND tons > 0, tons / active_hours, NULL)"
    return add(days, {
        "quantity_ratio": ratio("tons", "avg_tons", "1.0D"),
        "quality_ratio": ratio("fresh_pct", "avg_fresh_pct", "1.0D"),
        "peak_share": ratio("peak_tons", mean_hour, "1.0D"),
        "abs_tons_trend": "abs(tons_trend)",
        "abs_fresh_trend": "abs(fresh_trend)",
        "in_season_flag": "IF(month(report_date) IN (12, 1, 2, 3, 4), 1.0D, 0.0D)",
    })


def label_columns(days):
    """Targets: tons, fresh share, and a good day at a mean score of 4 or more."""
    return add(days, {
        "label_tons": double("tons"), "label_fresh": double("fresh_pct"),
        "label_good": "IF((quantity + quality + stability) / 3 >= 4, 1.0D, 0.0D)",
    })


def training_table(days, leak_free=False):
    """Features and labels per day.

    By default a day's features contain its own tons and fresh share, which are also the
    targets. `leak_free=True` takes the features of the calendar day before instead.
    """
    rows = label_columns(ml_features(days))
    labels = ("label_tons", "label_fresh", "label_good")
    if not leak_free:
        return rows.select("report_date", *FEATURES, *labels)
    # Both sides of the join come from one pass over the tickets.
    rows = settle(rows)
    before = rows.selectExpr("date_add(report_date, 1) AS report_date", *FEATURES)
    return before.join(rows.select("report_date", *labels), "report_date")
