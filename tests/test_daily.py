import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest

from conftest import ticket
from weighyard.operators import daily, rolling
from weighyard.operators.hourly import hour_frame


def days_of(spec):
    """Tickets from {day offset: [(net, cane), ...]} after 1 January 2025."""
    rows = []
    for offset, loads in spec.items():
        noon = dt.datetime(2025, 1, 1, 12) + dt.timedelta(days=offset)
        rows += [ticket(noon, net=n, cane=c, line="AB"[i % 2]) for i, (n, c) in enumerate(loads)]
    return rows


def on(df, offset, key="report_date"):
    day = dt.date(2025, 1, 1) + dt.timedelta(days=offset)
    return next(r for r in df.collect() if r[key] == day)


def test_baseline_is_per_day_with_data(tickets):
    t = tickets(*days_of({0: [(100, "1")], 2: [(50, "1"), (50, "2")], 8: [(1, "1")]}))
    r = on(rolling.baseline_7d(t), 8)  # looks back to offsets 1..7
    assert (r["avg_daily_tons"], r["avg_fresh_percent"], r["has_comparison_data"]) == (100.0, 50.0, True)
    first = on(rolling.baseline_7d(t), 0)
    assert (first["avg_daily_tons"], first["has_comparison_data"]) == (0.0, False)


def test_idle_days_can_be_asked_for(tickets):
    t = tickets(*days_of({0: [(100, "1")]}))
    assert rolling.baseline_7d(t).count() == 1
    idle = rolling.baseline_7d(t, idle_days=True)
    assert idle.count() == 8 and on(idle, 7)["avg_daily_tons"] == 100.0


def test_two_trends_differ(tickets):
    spec = {o: [(10, "1")] for o in range(0, 7)} | {o: [(20, "2")] for o in (7, 8, 9)} | {14: [(1, "1")]}
    t = tickets(*days_of(spec))
    a, b = on(rolling.trend_7v7(t), 14), on(rolling.rolling_trend(t), 14)
    assert (a["has_trend_data"], a["tons_trend_percent"], a["fresh_trend_percent"]) == (True, 100.0, -100.0)
    assert b["tons_trend_percent"] == pytest.approx(-100 / 7)
    early = on(rolling.trend_7v7(t), 3)
    assert early["has_trend_data"] is False and early["tons_trend_percent"] is None
    assert on(rolling.rolling_trend(t), 3)["tons_trend_percent"] == 0.0


def test_rolling_baseline_needs_three_data_days(tickets):
    t = tickets(*days_of({0: [(9, "1")], 1: [(9, "1")], 2: [(9, "1")], 3: [(9, "1")]}))
    got = rolling.rolling_baseline(t)
    assert on(got, 2)["has_comparison_data"] is False and on(got, 2)["avg_daily_tons"] == 0.0
    assert on(got, 3)["has_comparison_data"] is True and on(got, 3)["avg_daily_tons"] == 9.0
    back = rolling.ticket_with_baseline(t).collect()
    assert len(back) == 4 and {r["day_tons"] for r in back} == {Decimal("9.00")}


def test_trailing_against_brute_force(tickets):
    import random
    rng = random.Random(3)
    spec = {o: [(rng.randrange(1, 90), rng.choice("12")) for _ in range(rng.randrange(1, 4))]
            for o in range(60) if rng.random() < 0.7}
    t = tickets(*days_of(spec)).repartition(5)
    tons = {o: sum(n for n, _ in loads) for o, loads in spec.items()}
    got = {r["base_date"]: r for r in rolling.week_compare(t).collect()}
    assert len(got) == len(spec)
    for o in spec:
        now = [tons[x] for x in range(o - 6, o + 1) if x in tons]
        before = [tons[x] for x in range(o - 13, o - 6) if x in tons]
        r = got[dt.date(2025, 1, 1) + dt.timedelta(days=o)]
        assert (r["current_tons"], r["previous_tons"]) == (sum(now), sum(before))
        assert r["current_avg"] == pytest.approx(sum(now) / len(now))
        assert r["previous_avg"] == pytest.approx(sum(before) / len(before) if before else 0)
    rows = rolling.week_compare_daily(t).collect()
    sums = defaultdict(Decimal)
    for r in rows:
        sums[r["base_date"], r["period"]] += r["tons"]
    assert all(sums[d, "current"] == got[d]["current_tons"] for d in got)
    one = max(got)
    assert rolling.week_compare_daily(t, base_date=one).count() == sum(r["base_date"] == one for r in rows)


def test_performance_index(tickets):
    t = tickets(*days_of({0: [(240, "1")], 1: [(10, "1"), (20, "1")]}))
    got = rolling.performance_index(hour_frame(t))
    assert on(got, 0)["performance_index"] is None
    assert on(got, 1)["performance_index"] == 3.0  # 30 t in one hour against 240 t / 24 h


def test_season_totals_and_shares(tickets):
    rows = days_of({0: [(60, "1"), (40, "2")]}) + [ticket("2025-01-02 12:00:00", net=7, cane="3"),
                                                  ticket("2025-01-02 12:00:00", net=5, line="C")]
    t = tickets(*rows)
    r = daily.season_totals(t).first()
    assert (r["a_tons"], r["b_tons"], r["fresh_tons"], r["burnt_tons"]) == (60, 40, 65, 40)
    assert (r["a_trucks"], r["all_trucks"], r["season_tons"]) == (1, 3, 112)
    assert daily.season_totals(t, daily.season_total(t)).first().asDict() == r.asDict()
    s = on(daily.share_panel(t), 0)
    assert (s["fresh_pct"], s["burnt_pct"], s["season_a_tons_pct"], s["season_b_trucks_pct"]) == (60.0, 40.0, 60.0, 50.0)
    for one, other in (("season_fresh_pct", "season_burnt_pct"), ("season_a_tons_pct", "season_b_tons_pct")):
        assert s[one] + s[other] == pytest.approx(100)


def test_season_totals_without_tickets(tickets):
    t = tickets(dict(ts="2025-01-02 12:00:00", print_q="0"))
    assert daily.season_totals(t).first()["a_tons"] == 0
    summary = daily.daily_weight_summary(daily.daily_weight(t)).first()
    assert (summary["days"], summary["total_tons"], summary["avg_tons"]) == (0, 0.0, 0.0)


def test_relative_bounds_have_no_upper_end(tickets):
    t = tickets(*days_of({0: [(1, "1")], 40: [(3, "2")], 80: [(5, "1")]}))
    assert daily.ticket_stats(t, "2025-02-10").first()["tickets"] == 2
    assert [r["fresh_pct"] for r in daily.fresh_trend(t, "2025-02-10").collect()] == [0.0, 100.0]
    months = daily.season_trend(t, "2025-08-01").collect()
    assert [m["month"] for m in months] == ["2025-03", "2025-02"]


def test_daily_and_monthly(tickets):
    t = tickets(*days_of({0: [(10, "1"), (20, "2")], 31: [(4, "2")]}))
    d = on(daily.daily_weight(t), 0)
    assert (d["tons"], d["trucks"], d["a_tons"], d["b_tons"]) == (30, 2, 10, 20)
    m = {r["month"]: r for r in daily.monthly(t).collect()}
    assert (m["2025-01"]["trucks"], m["2025-01"]["fresh_trucks"], m["2025-02"]["burnt_tons"]) == (2, 1, 4)
    assert daily.daily_by_line(t, "2025-02-01", "2025-02-28").count() == 1
    assert on(daily.day_averages(hour_frame(t)), 0)["avg_a_tons"] == pytest.approx(10 / 24)
