"""Range forms of the trailing operators, sketches and the rollup."""

import datetime as dt
import random

import pytest

from conftest import ticket
from weighyard.operators import hourly, rolling, sketches
from weighyard.plans import dashboard
from weighyard.sources import sinks

FIRST, LAST = "2025-01-20", "2025-01-24"


@pytest.fixture
def stored(spark, tickets, tmp_path):
    """Sixty days of tickets in day partitions."""
    rng = random.Random(7)
    rows = [ticket(dt.datetime(2025, 1, 1) + dt.timedelta(days=d, hours=rng.randrange(18)), net=rng.randrange(10, 90),
                   line=rng.choice("AB"), cane=rng.choice("12"), truck=str(rng.randrange(40)))
            for d in range(60) for _ in range(rng.randrange(1, 6)) if d not in (21, 30)]
    path = str(tmp_path / "stored")
    sinks.write_tickets(tickets(*rows), path)
    return spark.read.parquet(path)


CASES = {
    "baseline_7d": (rolling.baseline_7d, "report_date", "2025-01-13"),
    "trend_7v7": (rolling.trend_7v7, "report_date", "2025-01-06"),
    "rolling_baseline": (rolling.rolling_baseline, "report_date", "2025-01-13"),
    "rolling_trend": (rolling.rolling_trend, "report_date", "2025-01-06"),
    "week_compare": (rolling.week_compare, "base_date", "2025-01-07"),
}


@pytest.mark.parametrize("name", CASES)
def test_range_is_the_full_result_cut_and_prunes_the_scan(stored, name):
    operator, day, scanned = CASES[name]
    cut = operator(stored, start=FIRST, end=LAST)
    whole = operator(stored).where(f"{day} BETWEEN DATE'{FIRST}' AND DATE'{LAST}'")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and cut.count() == 4
    plan = cut._jdf.queryExecution().executedPlan().toString()
    partition_filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert partition_filters
    for line in partition_filters:
        inside = line.split("PartitionFilters: [")[1].split("]")[0]
        assert f">= {scanned}" in inside and f"<= {LAST}" in inside


def test_idle_days_of_a_range(stored):
    days = [r.report_date.isoformat() for r in rolling.baseline_7d(stored, True, FIRST, LAST).orderBy("report_date").collect()]
    assert days == ["2025-01-20", "2025-01-21", "2025-01-22", "2025-01-23", "2025-01-24"]


def test_one_base_date_reads_fourteen_days(stored):
    found = rolling.week_compare_daily(stored, LAST)
    whole = rolling.week_compare_daily(stored).where(f"base_date = DATE'{LAST}'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert ">= 2025-01-11" in found._jdf.queryExecution().executedPlan().toString()


def test_open_ranges(stored):
    late = rolling.baseline_7d(stored, start="2025-02-20").collect()
    assert late and min(r.report_date for r in late) == dt.date(2025, 2, 20)
    early = rolling.baseline_7d(stored, end="2025-01-03").collect()
    assert max(r.report_date for r in early) == dt.date(2025, 1, 3)


def test_sketches_merge_over_ranges(stored):
    table = sketches.truck_sketches(stored)
    found = sketches.distinct_range(table, FIRST, LAST).first()
    exact = sketches.distinct_exact(stored, start=FIRST, end=LAST).first()
    assert (found.days, found.trucks) == (exact.days, exact.trucks)
    none = sketches.distinct_range(table, "2030-01-01", "2030-01-02").first()
    assert (none.days, none.trucks) == (0, 0)
    months = {r.month: r.trucks for r in sketches.distinct_by(table).collect()}
    for r in sketches.distinct_exact(stored, period="date_format(report_date, 'yyyy-MM')").collect():
        assert abs(months[r.month] - r.trucks) <= max(1, sketches.TOLERANCE * r.trucks)


def test_rollup_levels_add_up_with_two_shuffles(stored):
    found = hourly.hourly_rollup(stored)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = found.collect()
    season = [r for r in rows if r.level == "season"]
    assert len(season) == 1
    for c in hourly.TALLY:
        for level in ("slot", "day"):
            assert sum(r[c] for r in rows if r.level == level) == season[0][c]


def test_rollup_of_nothing(tickets):
    assert [r.total_count for r in hourly.hourly_rollup(tickets()).collect()] in ([], [0])


def test_dashboard_scans_the_tickets_once(stored):
    board = dashboard.dashboard(stored, "2025-03-01")
    assert "FileScan" not in board._jdf.queryExecution().executedPlan().toString()  # the settled hours only
    rows = board.collect()
    for r in rows:
        assert [h.slot for h in r.hours] == [c.slot for c in r.cumulative] == list(range(24))
        assert r.cumulative[-1].a_tons + r.cumulative[-1].b_tons == sum(h.total_tons for h in r.hours)
    assert {c.season_figures for c in rows} == {rows[0].season_figures}
