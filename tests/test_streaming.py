import datetime as dt
import random
import uuid

import pytest

from conftest import ticket
from weighyard.operators import hourly
from weighyard.streaming import live


@pytest.fixture
def feed(spark, tickets, tmp_path):
    """A folder of ticket files that a stream reads one file per batch, in order."""
    folder = tmp_path / "feed"
    folder.mkdir()

    class Feed:
        path = str(folder)

        def add(self, *rows):
            tickets(*rows).coalesce(1).write.mode("append").parquet(self.path)

        def run(self, build, run, **kwargs):
            stream = live.read_ticket_stream(spark, self.path, files_per_trigger=1)
            out = str(tmp_path / run)
            live.start_updates(build(stream, **kwargs), f"{out}/out", f"{out}/state").awaitTermination()
            return f"{out}/out"
    return Feed()


def _some(n, seed, begin=dt.datetime(2025, 1, 9, 17)):
    rng = random.Random(seed)
    return [ticket(begin + dt.timedelta(seconds=rng.randrange(40 * 3600)), net=rng.randrange(1, 900) / 10, line=rng.choice("ABC"),
                   cane=rng.choice("12"), lane=rng.choice(["1", "10"])) for _ in range(n)]


def test_stream_equals_batch(spark, tickets, feed):
    parts = [_some(60, s) for s in range(3)]
    for rows in parts:
        feed.add(*rows)
    out = feed.run(live.live_hourly, uuid.uuid4().hex, delay="72 hours")
    everything = tickets(*[r for rows in parts for r in rows])
    measures = ["a_count", "a_tons", "b_count", "b_tons", "fresh_tons", "burnt_tons", "total_count", "total_tons"]
    got = {(r["report_date"], r["slot"]): [r[m] for m in measures]
           for r in live.latest_updates(spark, out, ["report_date", "slot"]).collect()}
    batch = {(r["report_date"], r["slot"]): [r[m] for m in measures] for r in hourly.hourly_tally(everything).collect()}
    assert got == {k: v for k, v in batch.items() if k in got} and all(not any(v) for k, v in batch.items() if k not in got)

    days = live.latest_updates(spark, feed.run(live.live_day, uuid.uuid4().hex, delay="72 hours"), ["report_date"]).collect()
    for r in days:
        hours = [v for (d, _), v in batch.items() if d == r["report_date"]]
        assert r["total_tons"] == sum(v[-1] for v in hours) and r["active_hours"] == sum(v[-1] > 0 for v in hours)


def test_restart_goes_on_where_it_stopped(spark, feed):
    run = uuid.uuid4().hex
    feed.add(dict(ts="2025-01-10 09:00:00", net=10))
    feed.run(live.live_day, run)
    feed.add(dict(ts="2025-01-10 11:00:00", net=5))
    out = feed.run(live.live_day, run)
    feed.run(live.live_day, run)
    r = live.latest_updates(spark, out, ["report_date"]).collect()
    assert [(x["total_tons"], x["active_hours"]) for x in r] == [(15, 2)]


@pytest.mark.parametrize("delay, expected", [("24 hours", 15), ("1 hour", 10)])
def test_late_tickets(spark, feed, delay, expected):
    run = uuid.uuid4().hex
    for row in (dict(ts="2025-01-10 02:10:00", net=10), dict(ts="2025-01-10 16:00:00", net=1),
                dict(ts="2025-01-10 16:30:00", net=1), dict(ts="2025-01-10 02:20:00", net=5)):
        feed.add(row)
        out = feed.run(live.live_hourly, run, delay=delay)
    hour = [r for r in live.latest_updates(spark, out, ["report_date", "slot"]).collect() if r["slot"] == 8]
    assert hour[0]["total_tons"] == expected


def test_live_alerts(spark, feed, tmp_path):
    history = spark.createDataFrame(
        [(dt.date(2025, 1, 10), 1000.0, 90.0, True, -20.0)],
        "report_date date, avg_tons double, avg_fresh_pct double, has_trend boolean, tons_trend double")
    for hour in range(8):
        feed.add(dict(ts=f"2025-01-10 {hour:02d}:00:00", net=20, cane="12"[hour % 2]))
    stream = live.read_ticket_stream(spark, feed.path, files_per_trigger=8)
    out = str(tmp_path / "alerts")
    live.start_alerts(live.live_day(stream), history, out + "/out", out + "/state").awaitTermination()
    codes = [(r["level"], r["code"]) for r in spark.read.parquet(out + "/out").collect()]
    assert codes == [("critical", "VOLUME_VERY_LOW"), ("warning", "QUALITY_DROP"), ("critical", "EFFICIENCY_LOW"), ("warning", "TREND_DOWN")]


def test_live_tallies_need_utc(spark, feed):
    feed.add(dict(ts="2025-01-10 09:00:00"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Bangkok")
    try:
        with pytest.raises(ValueError):
            live.live_day(live.read_ticket_stream(spark, feed.path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
