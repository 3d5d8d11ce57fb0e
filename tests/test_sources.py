import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import ticket
from weighyard import schema as S
from weighyard.functions.guards import clean_numeric, percent_change, ratio
from weighyard.operators import hourly
from weighyard.plans import reports
from weighyard.sources import sinks, tickets as src, training_log


def test_guards(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (6.0, -1.0), (None, 3.0), (6.0, None)], "n double, d double")
    got = df.selectExpr(f"{ratio('n', 'd')} AS r", f"{ratio('n', 'd', '1.0D')} AS one", f"{percent_change('n', 'd')} AS c").collect()
    assert [r["r"] for r in got] == [2.0, 0.0, 0.0, 0.0, 0.0]
    assert [r["one"] for r in got] == [2.0, 1.0, 1.0, 1.0, 1.0]
    assert [r["c"] for r in got] == [100.0, 0.0, 0.0, 0.0, 0.0]


def test_clean_numeric(spark):
    df = spark.createDataFrame([(float("nan"), "none", 1), (float("-inf"), " 2.5 ", None), (1.5, "", 3)],
                               "x double, t string, i int")
    assert [tuple(r) for r in clean_numeric(df, ["x", "t", "i"]).collect()] == [(0.0, 0.0, 1.0), (0.0, 2.5, 0.0), (1.5, 0.0, 3.0)]
    assert clean_numeric(df).first()["t"] == "none"


def test_adapt_finds_and_renames_columns(spark):
    raw = spark.createDataFrame([(dt.date(2025, 1, 2), "A", 3.0)], "ReportDay date, PROD_LINE string, net double")
    out = src.adapt(raw, {"net_weight": "NET"})
    assert out.schema.simpleString() == S.TICKET.simpleString()
    r = out.first()
    assert (r["report_date"], r["prod_line"], r["net_weight"], r["lane_code"]) == (dt.date(2025, 1, 2), "A", Decimal("3.00"), None)
    with pytest.raises(KeyError):
        src.adapt(raw, {"net_weight": "weight"})
    with pytest.raises(KeyError):
        src.find_date_column(["a", "b"])
    assert src.find_date_column(["id", "shipDATE", "report"]) == "shipDATE"


def test_jdbc_splits_cover_every_day_and_hour_once():
    start, end = dt.date(2025, 1, 1), dt.date(2025, 1, 10)
    days = [d for c in src.jdbc_splits(start, end, 3) for d in [re.findall(r"'([\d-]+)'", c)]]
    assert days == [["2025-01-01", "2025-01-03"], ["2025-01-04", "2025-01-06"], ["2025-01-07", "2025-01-09"],
                    ["2025-01-10", "2025-01-10"]]
    split = src.jdbc_splits(start, start, hours_per_split=7)
    hours = [tuple(map(int, re.search(r"BETWEEN (\d+) AND (\d+)", c.split("AND (")[1]).groups())) for c in split]
    assert hours == [(0, 6), (7, 13), (14, 20), (21, 23)] and "IS NULL" in split[0]
    with pytest.raises(ValueError):
        src.jdbc_splits(start, end, hours_per_split=0)


def test_partitioned_round_trip_prunes_and_pushes(spark, tickets, tmp_path):
    rows = [ticket(f"2025-01-{d:02d} 09:00:00", net=d, ticket_id=d) for d in range(1, 11)]
    path = str(tmp_path / "tickets")
    sinks.write_tickets(tickets(*rows), path)
    got = src.read_tickets(spark, path, "2025-01-03", "2025-01-05", predicate="valid")
    assert {r["ticket_id"] for r in got.collect()} == {3, 4, 5}
    plan = got.groupBy("report_date").agg(F.sum("net_weight"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_date" in plan
    assert "ReadSchema: struct<net_weight:decimal(18,2),cane_type:string,print_q:string,print_w:string,lane_code:string>" in plan
    pushed = plan.split("PushedFilters:")[1]
    assert "EqualTo(print_q,5)" in pushed and "GreaterThan(net_weight,0" in pushed and "Not(In(lane_code" in pushed


def test_file_formats(spark, tickets, tmp_path):
    t = tickets(dict(ts="2025-01-10 09:00:00.250000", net="12.34"))
    for fmt in ("csv", "json", "orc"):
        path = str(tmp_path / fmt)
        sinks.export_table(t, path, fmt, partition_by=None)
        back = src.read_tickets(spark, path, fmt=fmt).select(*t.columns)
        assert [tuple(r) for r in back.collect()] == [tuple(r) for r in t.collect()]


def test_extract_order(tickets):
    t = tickets(dict(ts="2025-01-10 09:00:00"), dict(ts="2025-01-09 09:00:00"), dict(ts="2025-01-10 07:00:00"), dict(ts="2025-01-10 08:00:00", lane="10"))
    assert [r["ts"].hour for r in src.ticket_extract(t).collect()] == [9, 7, 9]
    assert src.ticket_extract(t, "2025-01-10", "2025-01-10", ordered=False).count() == 2


def test_training_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for start, end in (("2024-12-01", "2025-04-30"), ("2022-12-05", "2022-12-30"), ("", None)):
        training_log.append_training_log(spark, path, "2025-06-01 10:00:00", start, end, 110, 1000, "tickets", "models")
    log = training_log.read_training_log(spark, path)
    assert log.count() == 3
    assert [r["start"] for r in training_log.trained_ranges(log).collect()] == ["2022-12-05", "2024-12-01"]
    r = training_log.trained_years(log).first()
    assert (r["count"], r["years"]) == (2, [2022, 2024, 2025])


def test_report_text(tickets):
    frame = hourly.hour_frame(tickets(dict(ts="2025-01-10 09:00:00")))
    text = sinks.report_text(reports.efficiency_report(frame)).first()["report"]
    assert '"total_tons":10.0' in text and '"report_date":"2025-01-10"' in text
