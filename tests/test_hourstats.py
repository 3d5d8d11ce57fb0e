import datetime as dt
from decimal import Decimal

import pytest

from weighyard import schema as S
from weighyard.functions.student import two_sided_p
from weighyard.operators import daily, forecast, hourstats
from weighyard.plans import reports

FRAME = ("report_date date, slot int, a_count bigint, a_tons decimal(28,2), b_count bigint, b_tons decimal(28,2), "
         "fresh_tons decimal(28,2), burnt_tons decimal(28,2), all_count bigint, all_tons decimal(28,2), "
         "total_count bigint, total_tons decimal(28,2)")
D = dt.date(2025, 1, 10)


@pytest.fixture
def frame(spark):
    def build(tons, share_a=Decimal("0.6"), fresh=Decimal("0.7"), trucks=None, day=D):
        rows = []
        for slot, value in enumerate(tons):
            t = Decimal(value).quantize(Decimal("0.01"))
            n = max(1, int(t / 15)) if trucks is None else trucks
            rows.append((day, slot, n, t * share_a, 0, t - t * share_a, t * fresh, t - t * fresh, n, t, n, t))
        return spark.createDataFrame(rows, FRAME)
    return build


def golden():
    return [50 + 2 * i + (30 if 6 <= i <= 18 else 0) for i in range(24)]


def close(value, expected, digits=6):
    return value == pytest.approx(expected, abs=10 ** -digits)


def test_golden_day(frame):
    w = hourstats.battery(frame(golden()))
    r = w.first().asDict()
    assert (r["tons"], r["trucks"], r["active_hours"], r["max_tons"], r["min_tons"]) == (2142, 132, 24, 116, 50)
    assert [r[c] for c in ("high_hours", "medium_hours", "low_hours", "idle_hours")] == [9, 15, 0, 0]
    assert close(r["slope"], 2.16956522) and close(r["intercept"], 64.3) and close(r["r"], 0.70985386)
    assert close(r["p_value"], 0.00010222830, 10)
    assert (r["direction"], r["strength"]) == ("increasing", "strong")
    assert (r["first_half_avg"], r["second_half_avg"]) == (76.0, 102.5) and close(r["change_pct"], 34.86842105)
    assert close(r["mean_tons"], 89.25) and close(r["std_pop"], 21.15665774) and close(r["var_pop"], 447.60416667)
    assert close(r["cv_pct"], 23.70493864) and r["stability"] == "stable"
    assert [r[c] for c in ("q25", "q50", "q75", "iqr")] == [81.0, 95.0, 104.5, 23.5]
    assert r["outlier_slots"] == [] and r["peak_slots"] == list(range(13, 19)) and r["best_slot"] == 18
    assert r["peak_runs"] == [list(range(13, 19))]
    assert (r["efficiency_score"], r["productivity_score"]) == (100, 100)
    assert close(r["consistency_score"], 75.78521940) and close(r["balance_score"], 80)
    assert close(r["overall_index"], 89.94630485) and r["level"] == "excellent"
    assert close(r["balance_ratio"], 1.5) and r["balance"] == "unbalanced"
    assert [x["code"] for x in hourstats.hourly_recommendations(w).collect()] == ["BALANCE"]
    codes = [x["code"] for x in hourstats.hourly_insights(w).collect()]
    assert codes == ["ACTIVE_HOURS", "TONS_PER_HOUR", "TREND_INCREASING", "STABILITY_STABLE", "BEST_HOUR", "INDEX_EXCELLENT"]


def test_golden_forecast(frame):
    r = forecast.next_hour_forecast(frame(golden()), current_hour=23).first()
    assert (r["moving_avg"], r["prediction_hour"], r["confidence"]) == (94.0, 24, "high")
    assert close(r["trend"], 1.33333333) and close(r["predicted_tons"], 95.33333333) and close(r["std_tons"], 2.0)
    assert close(r["lower"], 91.41333333) and close(r["upper"], 99.25333333)
    assert forecast.next_hour_forecast(frame(golden())).count() == 22


def test_constant_hours(frame):
    r = hourstats.battery(frame([40] * 24)).first()
    assert (r["slope"], r["r"], r["p_value"], r["direction"], r["strength"]) == (0.0, 0.0, 1.0, "stable", "weak")
    assert (r["cv_pct"], r["stability"], r["consistency_score"]) == (0.0, "very_stable", 100.0)
    assert len(r["peak_slots"]) == 24 and r["best_slot"] == 0 and r["peak_runs"] == [list(range(24))]
    corr = hourstats.hourly_correlation(hourstats.battery(frame([40] * 24))).collect()
    assert len(corr) == 15 and {c["corr"] for c in corr} == {0.0}


def test_empty_day(frame):
    r = hourstats.battery(frame([0] * 24, trucks=0)).first()
    assert (r["overall_index"], r["level"], r["efficiency_ratio"]) == (0.0, "very_poor", 0.0)
    assert (r["tons_per_truck"], r["balance_ratio"], r["change_pct"]) == (0.0, 0.0, 0.0)


def test_one_line_day_has_no_balance(frame):
    r = hourstats.battery(frame(golden(), share_a=Decimal(1))).first()
    assert (r["balance_ratio"], r["balance"], r["balance_score"]) == (0.0, "unbalanced", 0.0)


def test_runs_outliers_and_tied_peak(frame):
    tons = [10] * 24
    for s in (2, 3, 7, 10, 11, 12):
        tons[s] = 30
    w = hourstats.battery(frame(tons))
    assert w.first()["peak_slots"] == [2, 3, 7, 10, 11, 12]
    assert [(r.first_slot, r.last_slot, r.length) for r in hourstats.peak_runs(w).orderBy("first_slot").collect()] == [
        (2, 3, 2), (10, 12, 3)]
    assert w.first()["best_slot"] == 2
    spike = [10 + i % 3 for i in range(23)] + [500]
    r = hourstats.hourly_outliers(hourstats.battery(frame(spike))).first()
    assert (r["outlier_count"], r["outlier_slots"]) == (1, [23])


def test_perfect_line(frame):
    r = hourstats.battery(frame([i for i in range(24)])).first()
    assert close(r["p_value"], 0.0, 10) and r["strength"] == "strong"


@pytest.mark.parametrize("t, dof, p", [(2.07387, 22, 0.05), (2.13145, 15, 0.05), (12.7062, 1, 0.05), (4.30265, 2, 0.05),
                                       (3.18245, 3, 0.05), (2.75, 30, 0.01), (0.0, 9, 1.0), (-2.07387, 22, 0.05)])
def test_student(spark, t, dof, p):
    got = spark.createDataFrame([(t, dof)], "t double, n int").selectExpr(f"{two_sided_p('t', 'n')} AS p")
    assert got.first()["p"] == pytest.approx(p, abs=2e-5)


def test_moving_average_and_cumulative(frame):
    f = frame([3, 6, 9] + [0] * 21)
    avg = {r["slot"]: r["moving_avg"] for r in hourstats.moving_avg(f).collect()}
    assert avg[0] is None and avg[23] is None and avg[1] == 6.0 and avg[2] == 5.0
    last = hourstats.cumulative(f).orderBy("slot").collect()[-1]
    assert last["cum_a_tons"] + last["cum_b_tons"] == 18 == last["cum_fresh_tons"] + last["cum_burnt_tons"]


def test_exec_summary(frame):
    tons = [0] * 24
    tons[4], tons[6], tons[9] = 20, 50, 50
    r = daily.exec_summary(frame(tons)).first()
    assert (r["active_hours"], r["peak_slot"], r["peak_label"]) == (3, 6, "00:00-01:00")
    assert (r["latest_slot"], r["latest_tons"], r["forecast_tons"], r["forecast_label"]) == (9, 50, 960.0, "early")
    empty = daily.exec_summary(frame([0] * 24)).first()
    assert (empty["peak_label"], empty["latest_tons"], empty["forecast_tons"], empty["forecast_label"]) == ("N/A", 0, 0.0, "")


def test_best_and_worst_day_ties_go_to_the_earliest(frame):
    days = [D + dt.timedelta(days=i) for i in range(4)]
    frames = frame(golden(), day=days[2]).union(frame(golden(), day=days[1])) \
        .union(frame([0] * 24, trucks=0, day=days[3])).union(frame([0] * 24, trucks=0, day=days[0]))
    r = hourstats.range_comparison(hourstats.battery(frames)).first()
    assert (r["days"], r["best_day"], r["worst_day"], r["worst_index"]) == (4, days[1], days[0], 0.0)
    assert close(r["avg_index"], 89.94630485 / 2) and r["avg_efficiency_ratio"] == 0.5
    kinds = {x["kind"]: x["report_date"] for x in hourstats.best_worst_day(hourstats.battery(frames)).collect()}
    assert kinds == {"best": days[1], "worst": days[0]}


def test_efficiency_report_is_complete(frame):
    r = reports.efficiency_report(frame(golden())).first()
    assert len(r["hourly_breakdown"]) == 24 and r["detailed_analysis"]["peaks"]["peak_runs"] == [list(range(13, 19))]
    assert r["executive_summary"]["performance_level"] == "excellent"
    assert [x["code"] for x in r["recommendations"]] == ["BALANCE"]


def test_fixed_values():
    assert S.EXCLUDED_LANES == ("10", "20", "30", "31", "40", "41", "50", "80", "81")
