import datetime as dt
import random

import pytest

from conftest import ticket
from weighyard.operators import forecast, training
from weighyard.plans import models
from weighyard.sources import training_log


@pytest.fixture(scope="module")
def history(spark):
    from weighyard import schema as S
    rng = random.Random(11)
    rows = []
    for day in range(40):
        for i in range(rng.randrange(6, 14)):
            at = dt.datetime(2024, 12, 1) + dt.timedelta(days=day, seconds=rng.randrange(86400))
            rows.append(ticket(at, net=rng.randrange(500, 3000) / 100, cane=rng.choice("112"), line=rng.choice("AB"),
                               ticket_id=day * 100 + i))
    return spark.createDataFrame(rows, S.TICKET)


def test_train_save_load_predict(spark, history, tmp_path):
    folder = str(tmp_path / "models")
    models.train_job(history, "2024-12-01", "2025-01-20", folder, trained_at="2025-02-01 08:00:00", trees=5, depth=4)
    log = training_log.read_training_log(spark, folder + "/training_history").collect()
    records = training.training_records(history, "2024-12-01", "2025-01-20")
    assert len(log) == 1 and log[0]["days_used"] == records.count() and log[0]["trained_at"] == "2025-02-01 08:00:00"
    loaded = models.load_models(folder)
    got = models.predict(loaded, records).collect()
    assert len(got) == log[0]["days_used"] and all(0 <= r["p_good"] <= 1 and r["predicted_tons"] > 0 for r in got)
    ahead = forecast.trend_outlook(models.predict_outlook(loaded, records))
    assert {r["outlook"] for r in ahead.collect()} <= {"up", "down", "flat"}


def test_too_few_days(history):
    table = training.training_table(training.training_records(history, "2024-12-01", "2024-12-08"))
    with pytest.raises(models.NotEnoughDays):
        models.fit_models(table)


def test_leak_free_features_come_from_the_day_before(history):
    days = training.training_records(history)
    same = {r["report_date"]: r for r in training.training_table(days).collect()}
    lagged = training.training_table(days, leak_free=True).collect()
    assert lagged
    for r in lagged:
        assert r["tons"] == same[r["report_date"] - dt.timedelta(days=1)]["tons"]
        assert r["label_tons"] == same[r["report_date"]]["tons"]


def test_last_ticket_and_peak_hour(tickets):
    rows = []
    for d in range(1, 6):
        rows += [dict(ts=f"2025-01-{d:02d} 09:10:00", net=5), dict(ts=f"2025-01-{d:02d} 12:00:00.500000", net=2, ticket_id=8),
                 dict(ts=f"2025-01-{d:02d} 12:00:00.500000", net="3.25", ticket_id=9), dict(ts=f"2025-01-{d:02d} 12:00:00", net=90, line="B", cane="2")]
    r = training.training_records(tickets(*rows)).first()
    assert (r["latest_tons"], r["peak_hour"], r["peak_tons"], r["active_hours"]) == (3.25, 12, 95.25, 2)
    assert r["latest_ts"].microsecond == 500000 and r["tickets"] == 4


# today, prediction -> clamped, change, outlook, adjusted
@pytest.mark.parametrize("today, raw, clamped, change, outlook, adjusted", [
    (100, 120, 120, 20, "up", False), (100, 130, 130, 25, "up", False), (100, 141, 100, 0, "steady", True),
    (100, 59, 100, 0, "steady", True), (100, 97, 97, -3, "down", False), (100, -5, 100, 0, "steady", True)])
def test_clamp(spark, today, raw, clamped, change, outlook, adjusted):
    df = spark.createDataFrame([(float(today), 80.0, float(raw), 101.0 if adjusted else 83.0)],
                               "tons double, fresh_pct double, predicted_tons double, predicted_fresh double")
    r = forecast.clamp_prediction(df).first()
    assert (r["clamped_tons"], r["tons_change_pct"], r["tons_outlook"], r["adjusted"]) == (clamped, change, outlook, adjusted)
    assert (r["clamped_fresh"], r["fresh_outlook"]) == ((80.0, "steady") if adjusted else (83.0, "better"))


def test_compare_with_prediction(spark):
    df = spark.createDataFrame([(80.0, 70.0, 100.0, 80.0, 0.1), (100.0, 80.0, 100.0, 80.0, 0.5), (120.0, 90.0, 100.0, 80.0, 0.9)],
                               "tons double, fresh_pct double, predicted_tons double, predicted_fresh double, p_good double")
    low, normal, high = forecast.compare_with_prediction(df).collect()
    assert low["model_findings"] == ["TONS_BELOW_PREDICTION", "FRESH_BELOW_PREDICTION", "GOOD_DAY_UNLIKELY"]
    assert low["model_actions"] == ["CHECK_TRANSPORT", "CHECK_BURNT_HANDLING", "FIND_CAUSES"]
    assert (normal["model_findings"], normal["model_actions"]) == (["NORMAL"], ["KEEP_STANDARD"])
    assert high["model_findings"] == ["TONS_ABOVE_PREDICTION", "FRESH_ABOVE_PREDICTION", "GOOD_DAY_LIKELY"]


def test_runs_are_commits(spark, history, tmp_path):
    folder = str(tmp_path / "runs")
    log = folder + "/training_history"

    def lines():
        return sorted((r.run_id, r.trained_at) for r in training_log.read_training_log(spark, log).collect())

    models.train_job(history, "2024-12-01", "2025-01-20", folder, "2025-02-01 08:00:00", trees=3, depth=3, run_id="a")
    models.train_job(history, "2024-12-01", "2025-01-20", folder, "2025-02-01 09:00:00", trees=3, depth=3, run_id="a")
    assert lines() == [("a", "2025-02-01 09:00:00")]
    # A run that breaks off has staged models but no line, and is not used.
    models.save_models({}, folder + "/runs/b")
    assert lines() == [("a", "2025-02-01 09:00:00")]
    models.train_job(history, "2024-12-05", "2025-01-20", folder, "2025-02-02 09:00:00", trees=3, depth=3)
    assert [r for r, _ in lines()] == ["20241205_20250120", "a"]
    newest = models.committed_models(spark, folder)
    chosen = models.committed_models(spark, folder, "a")
    days = training.training_records(history, "2024-12-01", "2025-01-20")
    assert models.predict(newest, days).count() == models.predict(chosen, days).count() == days.count()
    with pytest.raises(LookupError):
        models.committed_models(spark, folder, "b")


def test_facts_about_models(spark, history):
    days = training.training_records(history)
    fitted = models.fit_models(training.training_table(days), trees=5, depth=4)
    facts = {r.model: r for r in models.model_facts(fitted, days, fitted).collect()}
    assert set(facts) == {"tons", "fresh", "good"}
    assert all(r.inside and r.same_after_reload and r.days == days.count() for r in facts.values())
    assert facts["tons"].better_than_mean and facts["tons"].model_error < facts["tons"].mean_error
    assert models.model_facts(fitted, days).first().same_after_reload is None
    stats = {r.feature: r for r in models.scaler_stats(fitted, spark).collect()}
    tons = [r.tons for r in days.collect()]
    assert stats["tons"].mean == pytest.approx(sum(tons) / len(tons)) and len(stats) == 14
