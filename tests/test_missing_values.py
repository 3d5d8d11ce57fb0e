"""Tickets without a time, a date or an id, large ids, and ranges that keep their baselines."""

import datetime as dt
from decimal import Decimal

import pytest

from weighyard import schema as S
from weighyard.operators import hourly, rolling, training
from weighyard.plans import scorecard

def ticket(ident, ts, day, tons):
    return (ident, ts, day, Decimal(tons), S.LINE_A, S.FRESH, S.PRINTED_QUEUE, S.PRINTED_WEIGHT, "1", "7")


def at(day, hour, minute=0):
    return dt.datetime.combine(day, dt.time(hour, minute))


DAY = dt.date(2024, 1, 20)


def table(spark, rows):
    return spark.createDataFrame(rows, S.TICKET)


def test_ticket_without_time_counts_in_the_day_only(spark):
    tickets = table(spark, [ticket(1, at(DAY, 9), DAY, 10), ticket(2, at(DAY, 10), DAY, 20), ticket(3, None, DAY, 5)])
    tally = hourly.hourly_tally(tickets).collect()
    assert len(tally) == 24 and sum(r["total_tons"] for r in tally) == 30
    frame = hourly.hour_frame(tickets).collect()
    assert sum(r["all_tons"] for r in frame) == 35
    day = training.training_days(tickets).collect()[0]
    assert day["active_hours"] == 2 and day["tons"] == 35 and day["peak_hour"] == 10
    scorecard.daily_scorecard(tickets, "2024-02-01").collect()


def test_ticket_without_date_is_in_no_day(spark):
    tickets = table(spark, [ticket(1, at(DAY, 9), None, 7), ticket(2, at(DAY, 9), DAY, 3)])
    assert {r["report_date"] for r in hourly.hourly_tally(tickets).collect()} == {DAY}
    assert {r["base_date"] for r in rolling.week_compare(tickets).collect()} == {DAY}
    assert {r["report_date"] for r in training.training_days(tickets).collect()} == {DAY}


@pytest.mark.parametrize("partitions", [1, 3, 7])
@pytest.mark.parametrize("rows, last", [
    ([(2 ** 31 - 1, 11), (2 ** 31 + 1, 22)], 22),
    ([(-5, 11), (-7, 22)], 11),
    ([(None, 30), (-9, 22)], 22),
    ([(None, 30), (None, 40), (None, 10)], 40),
    ([(2 ** 62, 1), (2 ** 62 + 1, 2), (3, 9)], 2),
])
def test_last_ticket_of_the_hour_by_whole_id(spark, rows, last, partitions):
    tickets = table(spark, [ticket(i, at(DAY, 9), DAY, t) for i, t in rows]).repartition(partitions)
    assert training.training_days(tickets).collect()[0]["latest_tons"] == last


def test_range_of_the_scorecard_keeps_its_baselines(spark):
    days = [DAY - dt.timedelta(days=n) for n in range(20)]
    tickets = table(spark, [ticket(n, at(day, 9 + n % 5), day, 10 + n) for n, day in enumerate(days)])
    shown = ("report_date", "avg_tons", "tons_trend", "persona", "status")
    whole = {r["report_date"]: r for r in scorecard.daily_scorecard(tickets, "2024-02-01").select(*shown).collect()}
    part = scorecard.daily_scorecard(tickets, "2024-02-01", start="2024-01-18", end="2024-01-20").select(*shown).collect()
    assert len(part) == 3 and all(r == whole[r["report_date"]] for r in part)
