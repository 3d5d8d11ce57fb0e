import datetime as dt

import pytest

from weighyard.functions.codes import explode_findings
from weighyard.operators import advice, personas, rules
from weighyard.plans import reports, scorecard

JAN, DEC = dt.date(2025, 1, 15), dt.date(2024, 12, 15)


def case(day, t, v, f, g, h, p, trend=None, **extra):
    tt, ft = trend or (0.0, 0.0)
    return dict(report_date=day, tons=t, avg_tons=v, fresh_pct=f, avg_fresh_pct=g, active_hours=h, peak_tons=p,
                has_trend=trend is not None, tons_trend=tt, fresh_trend=ft) | extra


# name -> (input, scores, persona, anomaly score, overall score, anomaly codes)
GOLDEN = {
    "enhanced": (case(JAN, 1200, 1000, 85, 80, 12, 150, (5.2, 2.1)), (5, 4, 4), "EXCELLENT", 0, 10.0, None),
    "critical": (case(JAN, 400, 1000, 70, 80, 8, 80, (0, 0)), (1, 1, 2), "CRITICAL", 0.24, 1.2, ["VOLUME_LOW"]),
    "excellent": (case(JAN, 1400, 1000, 90, 80, 12, 180, (0, 0)), (5, 5, 4), "EXCELLENT", 0.16, 10.0, ["RATE_HIGH"]),
    "S1": (case(DEC, 3500, 2300, 85.5, 82, 12, 400), (5, 4, 4), "EXCELLENT", 0.2087, 10.0, ["VOLUME_HIGH", "RATE_HIGH"]),
    "S2": (case(DEC, 2300, 2300, 65, 82, 12, 250), (3, 1, 4), "STEADY_PERFORMANCE", 0.0622, 5.2,
           ["QUALITY_LOW", "RATE_HIGH"]),
    "S3": (case(DEC, 2300, 2300, 82, 82, 12, 250, line_a_tons=2000, line_b_tons=300), (3, 3, 4), "STEADY_PERFORMANCE", 0, 7.4,
           ["RATE_HIGH", "LINE_A_HIGH"]),
    "S4": (case(DEC, 2300, 2300, 98, 82, 12, 250, fresh_tons=2254, burnt_tons=46), (3, 5, 4), "STEADY_PERFORMANCE", 0.0585, 9.6,
           ["QUALITY_HIGH", "RATE_HIGH", "FRESH_HIGH"]),
    "realistic": (case(DEC, 2500, 2300, 85.5, 82, 12, 250, (8.2, 4.0)), (4, 4, 5), "EXCELLENT", 0, 9.4, ["RATE_HIGH"]),
    "web": (case(DEC, 4000, 2300, 95, 82, 8, 600, (15, 8), line_a_tons=3500, line_b_tons=500, fresh_tons=3800, burnt_tons=200),
            (5, 5, 5), "EXCELLENT", 0.6532, 10.0, ["VOLUME_HIGH", "QUALITY_HIGH", "RATE_HIGH", "LINE_A_HIGH"]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_days(day_rows, name):
    row, scores, persona, anomaly, overall, codes = GOLDEN[name]
    r = rules.overall_score(rules.anomalies(scorecard.scored(day_rows(row)))).first()
    assert (r["quantity"], r["quality"], r["stability"]) == scores
    assert r["persona"] == persona and r["status"] == "full"
    assert r["anomaly_score"] == pytest.approx(anomaly, abs=5e-5)
    assert r["overall_score"] == pytest.approx(overall, abs=1e-9)
    if codes is not None:
        assert [a["code"] for a in r["anomalies"]] == codes


def test_a_day_without_tons(day_rows):
    r = scorecard.analysed(day_rows(case(DEC, 0, 2300, 0, 82, 0, 0)), "2025-06-01").first()
    assert r["status"] == "no_data" and r["persona"] is None and r["overall_score"] == 0.0 and r["alerts"] is None
    s = scorecard.scored(day_rows(case(DEC, 0, 2300, 0, 82, 0, 0))).first()
    assert (s["quantity"], s["quality"], s["stability"], s["volume_eff"], s["volume_status"]) == (0, 0, 0, 0.0, "none")
    assert rules.anomalies(day_rows(case(DEC, 0, 2300, 0, 82, 0, 0))).first()["anomalies"] == []


@pytest.mark.parametrize("day, tons, based, status", [
    (dt.date(2024, 12, 31), 0, True, "holiday"), (dt.date(2025, 1, 2), 10, True, "holiday"),
    (dt.date(2025, 7, 1), 0, True, "no_data"), (dt.date(2025, 7, 1), 10, False, "off_season"),
    (dt.date(2025, 4, 30), 10, False, "no_baseline"), (dt.date(2024, 12, 1), 10, True, "full")])
def test_gate_order(day_rows, day, tons, based, status):
    row = case(day, tons, 10, 80, 80, 5, 3, has_baseline=based)
    assert scorecard.scored(day_rows(row)).first()["status"] == status


@pytest.mark.parametrize("day, context", [
    (dt.date(2024, 12, 29), "PRE_HOLIDAY_PUSH"), (dt.date(2024, 12, 28), None),
    (dt.date(2025, 1, 5), "POST_HOLIDAY_RESTART"), (dt.date(2025, 1, 6), None)])
def test_holiday_context(day_rows, day, context):
    row = day_rows(case(day, 100, 100, 80, 80, 12, 10)).selectExpr("*", "9L AS trucks", "20.0D AS burnt_pct")
    assert rules.calendar_context(row).first()["holiday_context"] == context
    report = reports.analysis_report(scorecard.analysed(row, "2025-06-01")).first()
    assert report["analysis"]["recommendation"] == (context or "IMPROVE")


# scores, trend, hours -> persona
@pytest.mark.parametrize("t, f, p, h, trend, expected", [
    (700, 80, 60, 7, None, "WEAK_START"), (700, 60, 60, 12, None, "CRITICAL"), (1200, 90, 110, 12, None, "EXCELLENT"),
    (1000, 80, 90, 12, (-6, -3), "CONCERNING_TREND"), (1000, 80, 90, 12, (6, 3), "STABLE_RECOVERY"),
    (1200, 70, 110, 12, None, "QUANTITY_PUSH"), (800, 90, 80, 12, None, "QUALITY_FOCUS"),
    (1000, 80, 200, 12, None, "VOLATILE_PERFORMANCE"), (1000, 80, 90, 12, None, "STEADY_PERFORMANCE")])
def test_each_persona(day_rows, t, f, p, h, trend, expected):
    r = rules.persona(rules.day_scores(day_rows(case(JAN, t, 1000, f, 80, h, p, trend)))).first()
    assert r["persona"] == expected


def test_persona_catalogue(spark, day_rows):
    table = personas.persona_table(spark).collect()
    assert len(table) == 9 and all(len(r["insights"]) == 3 and len(r["focus"]) == 3 for r in table)
    assert sorted(r["persona"] for r in table if r["root_causes"]) == sorted(personas.ROOT_CAUSES)
    days = rules.persona(rules.day_scores(day_rows(case(JAN, 700, 1000, 60, 80, 12, 60))))
    r = personas.persona_profile(days).first()
    assert (r["priority"], r["risk_level"], r["response_time"]) == ("critical", "high", "immediate")


@pytest.mark.parametrize("h, t, p, flow", [
    (3, 100, 99, None), (12, 1200, 250, "DENSE_CLUSTER"), (12, 1200, 180, "CLUSTER"), (12, 300, 30, "GAPS"), (12, 360, 30, None)])
def test_flow_pattern(day_rows, h, t, p, flow):
    assert rules.flow_pattern(day_rows(case(JAN, t, 1000, 80, 80, h, p))).first()["flow_pattern"] == flow


def alerts_of(day_rows, *rows):
    df = rules.alerts(scorecard.scored(day_rows(*rows)))
    return [(r["level"], r["code"]) for r in explode_findings(df, "alerts").collect()]


def test_alerts(day_rows):
    assert alerts_of(day_rows, case(JAN, 400, 1000, 60, 80, 8, 80, (-12, 0))) == [
        ("critical", "VOLUME_VERY_LOW"), ("warning", "QUALITY_DROP"), ("critical", "EFFICIENCY_LOW"), ("warning", "TREND_DOWN")]
    assert alerts_of(day_rows, case(JAN, 600, 1000, 80, 80, 8, 80)) == [
        ("warning", "VOLUME_LOW"), ("critical", "EFFICIENCY_LOW")]
    assert alerts_of(day_rows, case(JAN, 100, 1000, 80, 80, 4, 30)) == [("critical", "EFFICIENCY_LOW"), ("info", "SLOW_START")]
    late = case(dt.date(2025, 3, 12), 3100, 1000, 70, 80, 12, 300)
    assert alerts_of(day_rows, late) == [
        ("critical", "ANOMALY_HIGH"), ("warning", "RISK_FORECAST"), ("info", "SEASON_QUALITY"),
        ("success", "EFFICIENCY_EXCELLENT"), ("info", "LATE_SEASON")]
    assert alerts_of(day_rows, case(JAN, 1000, 1000, 80, 80, 12, 90)) == []


def test_insights_leave_out_what_the_persona_says(day_rows):
    rich = rules.insights(scorecard.scored(day_rows(case(JAN, 1200, 1000, 90, 80, 12, 110))))
    codes = rich.first()["insights"]
    assert codes[:3] == ["ABOVE_TARGET", "SMOOTH_TEAMWORK", "MACHINES_AT_CAPACITY"] and "VOLUME_ABOVE_TARGET" not in codes
    push = rules.insights(scorecard.scored(day_rows(case(JAN, 1200, 1000, 70, 80, 12, 110)))).first()["insights"]
    assert "QUALITY_BELOW_STANDARD" not in push and "VOLUME_ABOVE_TARGET" in push
    assert len(set(codes)) == len(codes)


def test_recommendations_by_mode(day_rows):
    row = case(dt.date(2025, 3, 14), 2000, 1000, 60, 80, 12, 170, (30, 10))
    rich = scorecard.scored(day_rows(row))
    now = advice.recommendations(rules.analysis_mode(rich, "2025-03-14"), 13).first()["recommendations"]
    assert [(r["priority"], r["category"]) for r in now] == [
        ("high", "QUALITY"), ("medium", "TIME_ADVICE"), ("medium", "TIME_ADVICE"), ("critical", "RISK"),
        ("medium", "SEASON"), ("high", "QUALITY_CONTROL"), ("medium", "WEEKEND")]
    past = advice.recommendations(rules.analysis_mode(rich, "2025-03-15"), 13).first()["recommendations"]
    assert [r["category"] for r in past] == ["QUALITY", "RISK", "SEASON", "QUALITY_CONTROL", "WEEKEND"]
    assert all(r["next_cycle"] and len(r["actions"]) == 4 for r in past)
    assert past[1]["priority"] == "medium" and past[1]["actions"][0] == advice.ACTIONS["RISK"][0]


@pytest.mark.parametrize("hour, part", [(5, "night"), (6, "morning"), (11, "morning"), (12, "afternoon"), (16, "afternoon"),
                                        (17, "evening"), (21, "evening"), (22, "night")])
def test_parts_of_the_day(hour, part):
    assert rules.day_part(hour) == part


def test_advice_follows_the_hour(day_rows):
    slow = scorecard.scored(day_rows(case(JAN, 100, 1000, 70, 80, 3, 50)))
    morning = advice.advice(slow, 8).first()
    assert "SLOW_MORNING" in morning["contextual"] and "MORNING_PREPARATION" in morning["practical"]
    assert morning["actionable"][:4] == ["MEET_TRANSPORT_TEAM", "CHECK_MISSING_TRUCKS", "SET_TARGETS", "CHECK_MACHINES"]
    good = scorecard.scored(day_rows(case(JAN, 1400, 1000, 90, 80, 16, 100)))
    assert "DAY_NEARLY_DONE" in advice.advice(good, 19).first()["contextual"]
    assert advice.advice(good, 23).first()["adaptive"] == []
    assert advice.advice(good, 13).first()["contextual"] == ["AFTERNOON_AHEAD", "VOLUME_ABOVE_TARGET"]


def test_projection_and_benchmarks(day_rows):
    rich = rules.benchmarks(rules.day_projection(scorecard.scored(day_rows(case(JAN, 600, 1000, 70, 80, 12, 80, (-6, 0))))))
    r = rich.first()
    assert r["projected_tons"] == 1200.0 and r["warnings"] == ["QUALITY_TOMORROW", "TREND_FALLING"]
    assert (r["remaining_target"], r["quality_gap"], r["trend_target"]) == (400.0, -10.0, 940.0)
    full = rules.day_projection(scorecard.scored(day_rows(case(JAN, 600, 0, 70, 0, 24, 80)))).first()
    assert full["projected_tons"] is None and full["volume_eff"] is None and full["quality_pattern"] is None


def test_deviation_can_be_given(day_rows):
    df = day_rows(case(JAN, 1250, 1000, 80, 80, 24, 60)).selectExpr("*", "100.0D AS std")
    assert [a["code"] for a in rules.anomalies(df, "std").first()["anomalies"]] == ["VOLUME_HIGH"]
    assert rules.anomalies(df).first()["anomalies"] == []


def test_time_context(day_rows):
    r = rules.time_context(day_rows(case(dt.date(2024, 12, 28), 1, 1, 1, 1, 1, 1)), 13).first()
    assert (r["weekday_name"], r["is_weekend"], r["holiday_season"], r["urgency"]) == ("Saturday", True, True, "high")


def test_scorecard_from_tickets_with_idle_days(tickets):
    rows = [dict(ts=f"2025-01-{d:02d} 10:{m:02d}:00", net=20, line="AB"[m % 2]) for d in (10, 11, 13) for m in range(6)]
    card = scorecard.daily_scorecard(tickets(*rows), "2025-02-01", start="2025-01-09", end="2025-01-14")
    got = {r["report_date"].day: r for r in card.collect()}
    assert {d: r["status"] for d, r in got.items()} == {
        9: "no_data", 10: "no_baseline", 11: "full", 12: "no_data", 13: "full", 14: "no_data"}
    assert got[13]["avg_tons"] == 120.0 and got[13]["persona"] and got[13]["mode"] == "historical"
    assert scorecard.flat_scorecard(card).count() == 6
