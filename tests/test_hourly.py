import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from conftest import ticket
from weighyard.functions.predicates import keep
from weighyard.operators import hourly


def by_slot(df):
    return {(r["report_date"], r["slot"]): r for r in df.collect()}


D = dt.date(2025, 1, 10)


def test_business_day_runs_from_18_to_18(tickets):
    t = tickets(dict(ts="2025-01-09 18:00:00"), dict(ts="2025-01-10 17:59:59"), dict(ts="2025-01-10 18:00:00"))
    rows = by_slot(hourly.hourly_tally(t))
    assert len(rows) == 48
    assert rows[D, 0]["a_count"] == 1 and rows[D, 0]["time_label"] == "18:00-19:00"
    assert rows[D, 23]["a_count"] == 1 and rows[D, 23]["time_label"] == "17:00-18:00"
    assert rows[dt.date(2025, 1, 11), 0]["a_count"] == 1


def test_missing_hours_are_zero_and_other_lines_count_by_type_only(tickets):
    t = tickets(dict(ts="2025-01-10 08:10:00", line="C", net=5), dict(ts="2025-01-10 08:20:00", line="B", cane="2", net="7.25"))
    rows = by_slot(hourly.hourly_tally(t))
    hour = rows[D, 14]
    assert (hour["fresh_tons"], hour["burnt_tons"], hour["total_tons"]) == (Decimal("5.00"), Decimal("7.25"), Decimal("7.25"))
    assert rows[D, 3]["total_tons"] == 0 and rows[D, 3]["b_count"] == 0


@pytest.mark.parametrize("bad", [
    dict(lane=None), dict(lane="31"), dict(net=0), dict(net=None), dict(print_q="4"), dict(print_w="n"), dict(cane="3")])
def test_every_part_of_the_predicate_bites(tickets, bad):
    t = tickets(dict(ts="2025-01-10 08:10:00"), dict(ts="2025-01-10 08:20:00") | bad)
    assert keep(t).count() == 1


def test_text_can_be_compared_without_case(tickets):
    t = tickets(dict(ts="2025-01-10 08:10:00", print_w="Y "))
    assert keep(t).count() == 0
    assert keep(t, ci=True).count() == 1


def test_bin_edges(tickets):
    t = tickets(dict(ts="2025-01-10 08:00:00"), dict(ts="2025-01-10 08:59:59.500000"), dict(ts="2025-01-10 08:59:59"))
    assert by_slot(hourly.hourly_tally(t))[D, 14]["a_count"] == 3
    assert by_slot(hourly.hourly_tally(t, closed="second"))[D, 14]["a_count"] == 2
    both = by_slot(hourly.hourly_tally(t, closed="both"))
    assert both[D, 14]["a_count"] == 3 and both[D, 13]["a_count"] == 1


def test_closed_bins_count_an_1800_ticket_in_two_days(tickets):
    rows = by_slot(hourly.queue_tally(tickets(dict(ts="2025-01-10 18:00:00", truck="x"))))
    assert rows[D, 23]["a_tons"] == 10 and rows[dt.date(2025, 1, 11), 0]["a_tons"] == 10
    assert rows[D, 23]["a_count"] == 0  # the queue number is no number


def test_seconds_between_bins_still_count_for_the_day(tickets):
    t = tickets(dict(ts="2025-01-10 08:59:59.500000"))
    frame = hourly.hour_frame(t, closed="second").collect()
    assert sum(r["total_tons"] for r in frame) == 0 and sum(r["all_tons"] for r in frame) == 10


def test_range_brings_idle_days_and_cuts_the_rest(tickets):
    t = tickets(dict(ts="2025-01-10 08:00:00"), dict(ts="2025-02-10 08:00:00"))
    rows = by_slot(hourly.hourly_tally(t, start="2025-01-09", end="2025-01-11"))
    assert len(rows) == 72 and sum(r["total_tons"] for r in rows.values()) == 10
    with pytest.raises(ValueError):
        hourly.hourly_tally(t, start="2025-01-09")
    with pytest.raises(ValueError):
        hourly.hourly_tally(t, closed="right")


def test_sums_stay_exact_for_any_weight(tickets):
    weights = ["9999999999999999.99", "0.01", "999999.99", "1000000.00", "1000000.01", "-1234567.89", "12.34"]
    t = tickets(*[dict(ts="2025-01-10 08:00:00", net=w) for w in weights])
    row = by_slot(hourly.hourly_tally(t, predicate="all"))[D, 14]
    assert row["a_tons"] == sum(Decimal(w) for w in weights)


def _random_tickets(n, seed):
    rng = random.Random(seed)
    begin = dt.datetime(2025, 1, 5)
    return [ticket(begin + dt.timedelta(seconds=rng.randrange(6 * 86400)), net=rng.randrange(1, 5000) / 100,
                   line=rng.choice("ABC"), cane=rng.choice("12"), ticket_id=i) for i in range(n)]


def test_against_brute_force_whatever_the_partitioning(spark, tickets):
    rows = _random_tickets(700, 5)
    # A third of all rows on one hour.
    rows += [ticket("2025-01-07 09:30:00", net=1.5, ticket_id=1000 + i) for i in range(350)]
    expected = defaultdict(Decimal)
    for r in rows:
        if r[4] in "AB":
            expected[r[2], (r[1].hour + 6) % 24] += r[3]
    for parts in (1, 7):
        got = by_slot(hourly.hourly_tally(tickets(*rows).repartition(parts)))
        assert {k: r["total_tons"] for k, r in got.items() if r["total_tons"]} == dict(expected)
        days = {d for d, _ in got}
        assert len(got) == 24 * len(days)


def test_total_rows_equal_the_hours(tickets):
    tally = hourly.hourly_tally(tickets(*_random_tickets(200, 1)))
    rows = hourly.with_day_total(tally).collect()
    hours, totals = defaultdict(Decimal), {}
    for r in rows:
        if r["is_total"]:
            totals[r["report_date"]] = r["total_tons"]
            assert r["slot"] is None and r["time_label"] == "TOTAL"
        else:
            hours[r["report_date"]] += r["total_tons"]
    assert totals == dict(hours)


def test_grid_sort_is_numeric_where_text_is_a_number(spark):
    df = spark.createDataFrame([("1,200.00",), ("30.00",), ("9",), ("n/a",)], "v string")
    assert [r.v for r in hourly.sorted_table(df, "v").collect()] == ["9", "30.00", "1,200.00", "n/a"]
    assert [r.v for r in hourly.sorted_table(df, "v", descending=True).collect()][:2] == ["1,200.00", "30.00"]


def test_hour_efficiency_bounds(tickets):
    t = tickets(dict(ts="2025-01-10 08:00:00", net=100), dict(ts="2025-01-10 09:00:00", net="100.01"),
                dict(ts="2025-01-10 10:00:00", net=50))
    rows = by_slot(hourly.hour_efficiency(hourly.hourly_tally(t)))
    assert [rows[D, s]["efficiency"] for s in (13, 14, 15, 16)] == ["none", "normal", "high", "low"]


def test_heatmap_uses_the_clock_hour_and_the_weak_predicate(tickets):
    t = tickets(dict(ts="2025-01-09 19:00:00", cane="3", net=4))
    row = hourly.heatmap(t).first()
    assert row["report_date"] == D and row["h19"] == 4 and row["h01"] == 0
