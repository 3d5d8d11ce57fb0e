"""Tallies per business day and hour slot."""

from pyspark.sql import functions as F

from weighyard import schema as S
from weighyard.functions.clock import (
    business_date, closed_places, seconds_into_hour, slot_label, slot_of,
)
from weighyard.functions.layers import add, aggregates
from weighyard.functions.predicates import keep
from weighyard.functions.text import number_in_text

MEASURES = ("a_count", "a_tons", "b_count", "b_tons", "fresh_tons", "burnt_tons",
            "all_count", "all_tons")
TALLY = ("a_count", "a_tons", "b_count", "b_tons", "fresh_tons", "burnt_tons",
         "total_count", "total_tons")

ON_A = f"prod_line = '{S.LINE_A}'"
ON_B = f"prod_line = '{S.LINE_B}'"
IS_FRESH = f"cane_type = '{S.FRESH}'"
IS_BURNT = f"cane_type = '{S.BURNT}'"
WEIGHT = "CAST(net_weight AS DECIMAL(18,2))"
ZERO = "CAST(0 AS DECIMAL(28,2))"


# A sum of DECIMAL(18,2) is wider than 18 digits and adds big-number objects row by row.
# The weights are therefore summed in two parts that Spark adds as plain longs: what is
# left below a million tons, and the whole millions (none for any real truck). The result
# is the same exact decimal for every weight the type can hold, in about half the time.
_MILLION = 1_000_000
_USUAL = f"try_cast({WEIGHT} AS DECIMAL(8,2))"
_BELOW = f"coalesce({_USUAL}, CAST({WEIGHT} % {_MILLION} AS DECIMAL(8,2)))"
_HEAVY = f"{_USUAL} IS NULL AND net_weight IS NOT NULL"


def tons_where(condition="true"):
    """Exact decimal sum of the weights under a condition; 0 where there are none."""
    below = f"sum(IF({condition}, {_BELOW}, NULL))"
    millions = f"sum(IF({condition} AND {_HEAVY}, {WEIGHT} DIV {_MILLION}, NULL))"
    return (f"CAST(coalesce({below}, 0) + coalesce(CAST({millions} AS DECIMAL(18,0)), 0) * {_MILLION} "
            "AS DECIMAL(28,2))")


def count_where(condition="true"):
    return f"count_if({condition})"


def _slot_measures(in_slot):
    """The sums every tally is built from.

    The `all_` columns count a ticket whatever its line, and also where it falls between
    the bins of the 'second' mode.
    """
    return {
        "a_count": count_where(f"{in_slot} AND {ON_A}"), "a_tons": tons_where(f"{in_slot} AND {ON_A}"),
        "b_count": count_where(f"{in_slot} AND {ON_B}"), "b_tons": tons_where(f"{in_slot} AND {ON_B}"),
        "fresh_tons": tons_where(f"{in_slot} AND {IS_FRESH}"),
        "burnt_tons": tons_where(f"{in_slot} AND {IS_BURNT}"),
        "all_count": "count(net_weight)", "all_tons": tons_where(),
    }


def slot_sums(tickets, closed="left", start=None, end=None):
    """One row per (report_date, slot) that has tickets.

    closed='left'    half-open hours
    closed='second'  hours end at hh:59:59, so the last fraction of a second is lost
    closed='both'    closed hours on the time stamp alone: a ticket on the full hour
                     counts in two slots, and in two days at 18:00

    With `start` and `end` every day of the range is present, tickets or not. A ticket without
    a time is in no slot, but in its day's `all_` columns (those of slot 0); one without a
    report date is in no day.
    """
    if closed not in ("left", "second", "both"):
        raise ValueError(f"unknown bin edge {closed!r}")
    if (start is None) != (end is None):
        raise ValueError("give both ends of the range")
    facts = ("prod_line", "cane_type", "net_weight")
    if closed == "both":
        rows = tickets.selectExpr(f"explode({closed_places()}) AS ts", *facts).selectExpr(
            f"{business_date()} AS report_date", f"{slot_of()} AS slot", "true AS in_slot", *facts)
    else:
        inside = f"{seconds_into_hour()} <= 3599" if closed == "second" else "true"
        rows = tickets.selectExpr("report_date", f"coalesce({slot_of()}, 0) AS slot",
                                  f"ts IS NOT NULL AND {inside} AS in_slot", *facts)
    rows = rows.where("report_date IS NOT NULL")
    if start is not None:
        days = rows.sparkSession.range(1).selectExpr(
            f"explode(sequence(DATE'{start}', DATE'{end}')) AS report_date", "0 AS slot")
        rows = keep(rows, "all", start, end).unionByName(days, allowMissingColumns=True)
    return rows.groupBy("report_date", "slot").agg(*aggregates(_slot_measures("in_slot")))


def fill_slots(sums):
    """All 24 slots of every day that occurs, the missing ones as zeros.

    A day has at most 24 rows here, so gathering them is bounded. The result stays
    partitioned by report_date: later grouping or windows by day need no new shuffle.
    """
    gathered = sums.groupBy("report_date").agg(*aggregates({
        "by_slot": f"map_from_entries(collect_list(struct(slot, struct({', '.join(MEASURES)}))))",
    }))
    placed = gathered.selectExpr(
        "report_date",
        f"inline(transform(sequence(0, {S.SLOTS_PER_DAY - 1}), "
        "i -> named_struct('slot', i, 'm', try_element_at(by_slot, i))))",
    )
    zero = {name: "0L" if name.endswith("count") else ZERO for name in MEASURES}
    return placed.selectExpr(
        "report_date", "slot", *[f"coalesce(m.{name}, {zero[name]}) AS {name}" for name in MEASURES])


def _with_totals(rows):
    return add(rows, {
        "total_count": "a_count + b_count",
        "total_tons": "CAST(a_tons + b_tons AS DECIMAL(28,2))",
    })


def hour_frame(tickets, predicate="valid", closed="left", start=None, end=None):
    """The gap-filled tally with the `all_` columns; the input of the day-level plans."""
    counted = keep(tickets, predicate)
    return _with_totals(fill_slots(slot_sums(counted, closed, start, end)))


def hourly_tally(tickets, predicate="valid", closed="left", start=None, end=None):
    """24 rows per day: trucks and tons by line, tons by cane type, line totals.

    Tickets on other lines are in the fresh and burnt tons but not in the totals.
    """
    frame = hour_frame(tickets, predicate, closed, start, end)
    return frame.selectExpr("report_date", "slot", f"{slot_label()} AS time_label", *TALLY)


def queue_tally(tickets, predicate="valid", closed="both"):
    """Desk variant: closed hours on the time stamp, trucks counted by queue number."""
    places = closed_places() if closed == "both" else "array(ts)"
    rows = keep(tickets, predicate).where(f"{ON_A} OR {ON_B}").selectExpr(
        f"explode({places}) AS place", "prod_line", "net_weight",
        "try_cast(truck_q AS DECIMAL(18,2)) IS NOT NULL AS queued",
    ).selectExpr(f"{business_date('place')} AS report_date", f"{slot_of('place')} AS slot",
                 "prod_line", "net_weight", "queued")
    sums = rows.groupBy("report_date", "slot").agg(*aggregates({
        "a_count": count_where(f"{ON_A} AND queued"), "a_tons": tons_where(ON_A),
        "b_count": count_where(f"{ON_B} AND queued"), "b_tons": tons_where(ON_B),
        "fresh_tons": ZERO, "burnt_tons": ZERO, "all_count": "0L", "all_tons": ZERO,
    }))
    return _with_totals(fill_slots(sums)).selectExpr(
        "report_date", "slot", f"{slot_label()} AS time_label",
        "a_count", "a_tons", "b_count", "b_tons", "total_count", "total_tons")


def with_day_total(tally):
    """Append one total row per day (slot NULL, label 'TOTAL')."""
    grouped = tally.groupingSets(
        [["report_date", "slot"], ["report_date"]], "report_date", "slot"
    ).agg(*aggregates({**{c: f"sum({c})" for c in TALLY}, "is_total": "grouping(slot) = 1"}))
    label = f"IF(is_total, 'TOTAL', {slot_label()}) AS time_label"
    return grouped.selectExpr("report_date", "slot", label, *TALLY, "is_total")


def hourly_rollup(tickets, predicate="valid"):
    """Slot, day and season rows of the tally in one result, told apart by `level`.

    The tickets are reduced to slots first, so the rollup multiplies at most 24 rows a day by three
    and not the tickets; its shuffle is the only one behind the slot sums.
    """
    slots = _with_totals(slot_sums(keep(tickets, predicate)))
    rolled = slots.rollup("report_date", "slot").agg(*aggregates(
        {**{c: f"sum({c})" for c in TALLY}, "depth": "grouping_id()"}))
    # No ticket at all leaves the season row with NULL sums.
    zero = {c: "0L" if c.endswith("count") else ZERO for c in TALLY}
    return rolled.selectExpr(
        "CASE depth WHEN 0 THEN 'slot' WHEN 1 THEN 'day' ELSE 'season' END AS level", "report_date", "slot",
        *[f"coalesce({c}, {zero[c]}) AS {c}" for c in TALLY])


def hour_efficiency(tally, high=100, normal=50):
    """Label every hour: > high, > normal, > 0, or nothing weighed."""
    return add(tally, {"efficiency": (
        f"CASE WHEN total_tons > {high} THEN 'high' WHEN total_tons > {normal} THEN 'normal' "
        "WHEN total_tons > 0 THEN 'low' ELSE 'none' END")})


def heatmap(tickets, predicate="printed", start=None, end=None):
    """Days by clock hour (not slot), tons, empty cells 0. The 24 columns are fixed."""
    hours = list(range(24))
    cells = keep(tickets, predicate, start, end).groupBy(
        "report_date", F.expr("hour(ts)").alias("clock_hour")
    ).agg(*aggregates({"tons": tons_where()}))
    wide = cells.groupBy("report_date").pivot("clock_hour", hours).agg(F.sum("tons"))
    return wide.selectExpr("report_date", *[f"coalesce(`{h}`, {ZERO}) AS h{h:02d}" for h in hours])


def sorted_table(df, column, descending=False):
    """Order by a column the way a grid does: by number where its text is a number."""
    text = f"CAST({column} AS STRING)"
    keys = [F.expr(number_in_text(text)), F.expr(text)]
    return df.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys])
