"""Live tables: merged by day, alerts that are withdrawn, tickets beyond the watermark."""

import datetime as dt
import random
import uuid
from pathlib import Path

import pytest

from conftest import ticket
from weighyard.operators import hourly
from weighyard.streaming import live, serving


class Feed:
    """Deliveries of tickets to a folder; a stream is run once after each."""

    def __init__(self, spark, tickets, folder):
        self.spark, self.tickets, self.path = spark, tickets, str(folder / "tickets")

    def add(self, *rows):
        self.tickets(*rows).write.mode("append").parquet(self.path)

    def stream(self):
        return live.read_ticket_stream(self.spark, self.path)


@pytest.fixture
def feed(spark, tickets, tmp_path):
    return Feed(spark, tickets, tmp_path)


def some(n, seed, begin=dt.datetime(2025, 1, 9, 19), hours=40):
    rng = random.Random(seed)
    return [ticket(begin + dt.timedelta(seconds=rng.randrange(hours * 3600)), net=rng.randrange(1, 900) / 10,
                   line=rng.choice("ABC"), cane=rng.choice("12"), lane=rng.choice(["1", "10"]), ticket_id=seed * 10000 + k)
            for k in range(n)]


def tally(rows):
    return {(r["report_date"], r["slot"]): tuple(r[c] for c in hourly.TALLY) for r in rows
            if r["total_count"] or r["fresh_tons"] + r["burnt_tons"] > 0}


def files(path):
    return [p for p in Path(path).rglob("*.parquet")]


def test_hour_table_has_one_file_per_day_however_many_batches(spark, tickets, feed, tmp_path):
    out, everything = str(tmp_path / "out"), []
    counts = []
    for seed in range(5):
        rows = some(40, seed)
        everything += rows
        feed.add(*rows)
        serving.start_table(live.live_hourly(feed.stream(), "72 hours"), f"{out}/hours", f"{out}/state",
                            ("report_date", "slot")).awaitTermination()
        counts.append(len(files(f"{out}/hours")))
    assert counts[-1] == counts[0] == 2
    table = spark.read.parquet(f"{out}/hours").collect()
    assert tally(table) == tally(hourly.hourly_tally(tickets(*everything)).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2025, 1, 10), 3, 5), (dt.date(2025, 1, 11), 4, 6)], "report_date date, slot int, n int")
    path = str(tmp_path / "t")
    serving.merge_days(rows, path, ("report_date", "slot"))
    changed = spark.createDataFrame([(dt.date(2025, 1, 10), 3, 9), (dt.date(2025, 1, 10), 7, 1)], "report_date date, slot int, n int")
    for _ in range(2):
        serving.merge_days(changed, path, ("report_date", "slot"))
        found = sorted((r.report_date.day, r.slot, r.n) for r in spark.read.parquet(path).collect())
        assert found == [(10, 3, 9), (10, 7, 1), (11, 4, 6)]


def week(first, days, tons):
    """Days of 20 even hours each."""
    return [ticket(dt.datetime.combine(first + dt.timedelta(days=d), dt.time(h)), net=tons / 20, line="AB"[h % 2], cane="1")
            for d in range(days) for h in range(0, 18)] + [
            ticket(dt.datetime.combine(first + dt.timedelta(days=d - 1), dt.time(h)), net=tons / 20, line="A", cane="1")
            for d in range(days) for h in (20, 21)]


def alert_rows(spark, out):
    return sorted((str(r.report_date), r.code, r.state, r.opened_batch, r.closed_batch)
                  for r in serving.read_days(spark, f"{out}/alerts", serving.ALERT_TABLE).collect())


def run_alerts(feed, out):
    serving.start_alert_table(live.live_day(feed.stream(), "90 days", whole=True), out, f"{out}/state").awaitTermination()


def test_alerts_are_opened_withdrawn_and_opened_again(spark, feed, tmp_path):
    out = str(tmp_path / "alerts")
    feed.add(*week(dt.date(2025, 1, 3), 7, 1000))
    run_alerts(feed, out)
    assert alert_rows(spark, out) == []
    # Half a day's tickets by ten hours: far too little.
    feed.add(*[ticket(f"2025-01-10 {h:02d}:00:00", net=30, cane="1") for h in range(10)])
    run_alerts(feed, out)
    opened = alert_rows(spark, out)
    assert [(d, c, s) for d, c, s, _, _ in opened] == [
        ("2025-01-10", "EFFICIENCY_LOW", "open"), ("2025-01-10", "VOLUME_VERY_LOW", "open")]
    # The rest comes in: withdrawn, and still on record.
    feed.add(ticket("2025-01-10 11:00:00", net=900, cane="1"))
    run_alerts(feed, out)
    closed = alert_rows(spark, out)
    assert [(c, s) for _, c, s, _, _ in closed] == [("EFFICIENCY_LOW", "closed"), ("VOLUME_VERY_LOW", "closed")]
    assert all(b > a for _, _, _, a, b in closed) and serving.open_alerts(spark, out).count() == 0
    # Late tickets of an earlier day raise the baseline, so the later day is judged again.
    feed.add(*[ticket(f"2025-01-08 {h:02d}:30:00", net=3000, cane="1") for h in range(10)])
    run_alerts(feed, out)
    codes = {(d, c) for d, c, s, _, _ in alert_rows(spark, out) if s == "open"}
    assert {("2025-01-10", "EFFICIENCY_LOW"), ("2025-01-10", "VOLUME_VERY_LOW"), ("2025-01-09", "EFFICIENCY_LOW")} <= codes


def test_alert_merge_is_idempotent_and_leaves_other_days(spark, tmp_path):
    path, day, other = str(tmp_path / "a"), dt.date(2025, 1, 10), dt.date(2025, 1, 11)

    def found(*rows):
        return spark.createDataFrame(list(rows), "report_date date, level string, code string, value double")

    judged = spark.createDataFrame([(day,), (other,)], "report_date date")
    serving.merge_alerts(spark, judged, found((day, "info", "X", 1.0), (other, "info", "Y", 2.0)), path, 0)
    only = judged.where("report_date = DATE'2025-01-10'")
    for _ in range(2):
        serving.merge_alerts(spark, only, found(), path, 1)
        rows = {r.code: (r.state, r.opened_batch, r.closed_batch) for r in spark.read.parquet(path).collect()}
        assert rows == {"X": ("closed", 0, 1), "Y": ("open", 0, None)}
    serving.merge_alerts(spark, only, found((day, "info", "X", 3.0)), path, 2)
    rows = {r.code: (r.state, r.value, r.opened_batch, r.closed_batch) for r in spark.read.parquet(path).collect()}
    assert rows["X"] == ("open", 3.0, 2, None)


def test_days_laid_down_beforehand_are_the_baseline(spark, tickets, feed, tmp_path):
    out = str(tmp_path / "seeded")
    serving.write_day_table(tickets(*week(dt.date(2025, 1, 3), 7, 1000)), out)
    feed.add(*[ticket(f"2025-01-10 {h:02d}:00:00", net=30, cane="1") for h in range(10)])
    run_alerts(feed, out)
    assert {c for _, c, s, _, _ in alert_rows(spark, out)} == {"EFFICIENCY_LOW", "VOLUME_VERY_LOW"}


@pytest.mark.parametrize("late, dropped", [("2025-01-13 20:00:00", False), ("2025-01-10 02:20:00", True)])
def test_late_tickets_inside_and_outside_the_delay(spark, tickets, feed, tmp_path, late, dropped):
    out = str(tmp_path / uuid.uuid4().hex)
    parts = [some(60, 1), some(60, 2, dt.datetime(2025, 1, 13, 0), 20), [ticket(late, net=500, ticket_id=1, line="A")]]
    schema = live.live_hourly(tickets(), whole=True).schema
    for rows in parts:
        feed.add(*rows)
        serving.start_table(live.live_hourly(feed.stream(), "24 hours", whole=True), f"{out}/hours", f"{out}/s1",
                            ("report_date", "slot")).awaitTermination()
        serving.start_arrivals(feed.stream(), f"{out}/arrivals", f"{out}/s2").awaitTermination()
    wanted = tally(hourly.hourly_tally(tickets(*[r for rows in parts for r in rows])).collect())

    def now():
        return tally(serving.read_days(spark, f"{out}/hours", schema).collect())

    assert (now() != wanted) == dropped
    stored = spark.read.parquet(feed.path)
    mended = serving.retally_short_days(stored, f"{out}/hours", schema, f"{out}/arrivals").collect()
    assert [r.report_date for r in mended] == ([dt.date(2025, 1, 10)] if dropped else [])
    assert now() == wanted
    assert serving.retally_short_days(stored, f"{out}/hours", schema, f"{out}/arrivals").count() == 0


def test_reading_days_prunes_partitions(spark, tickets, tmp_path):
    path = str(tmp_path / "p")
    serving.write_day_table(tickets(*week(dt.date(2025, 1, 3), 7, 1000)), path)
    schema = spark.read.parquet(f"{path}/days").schema
    days = spark.createDataFrame([(dt.date(2025, 1, 4),)], "report_date date")
    found = serving.read_days(spark, f"{path}/days", schema, days)
    assert found.count() == 1
    assert "PartitionFilters: [isnotnull(report_date" in found._jdf.queryExecution().executedPlan().toString()
