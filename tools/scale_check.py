"""Larger, skewed tickets: write them once, then time the main operators.

    python tools/scale_check.py FOLDER [million_rows]

A third of all rows falls on a single hour of a single day. FOLDER must be new.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weighyard.operators import daily, hourly, hourstats, rolling, training  # noqa: E402
from weighyard.plans import scorecard  # noqa: E402
from weighyard.session import build_session  # noqa: E402
from weighyard.sources.tickets import read_tickets  # noqa: E402


def make(spark, path, millions):
    hot = "id % 3 = 0"
    moment = (f"TIMESTAMP_NTZ'2015-01-01 00:00:00' + INTERVAL '1' SECOND * "
              f"IF({hot}, 157766400 + id % 3600, pmod(xxhash64(id), 315360000))")
    spark.range(millions * 1_000_000).selectExpr(
        "id AS ticket_id", f"{moment} AS ts",
        "CAST(pmod(xxhash64(id, 1), 3000) / 100 + 5 AS DECIMAL(18,2)) AS net_weight",
        "IF(pmod(xxhash64(id, 2), 10) < 6, 'A', 'B') AS prod_line",
        "IF(pmod(xxhash64(id, 3), 10) < 7, '1', '2') AS cane_type",
        "IF(pmod(xxhash64(id, 4), 50) = 0, '0', '5') AS print_q", "'y' AS print_w",
        "CAST(pmod(xxhash64(id, 5), 100) AS STRING) AS lane_code", "CAST(id AS STRING) AS truck_q",
    ).selectExpr("*", "CAST(ts + INTERVAL 6 HOURS AS DATE) AS report_date").write.parquet(path)


def main():
    folder, millions = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 60
    spark = build_session("scale", "local[8]", shuffle_partitions=64,
                          extra={"spark.driver.memory": "8g", "spark.checkpoint.dir": folder + "/shared"})
    spark.sparkContext.setLogLevel("ERROR")
    path = folder + "/tickets"
    if not os.path.exists(path):
        make(spark, path, millions)
    tickets = read_tickets(spark, path)
    frame = hourly.hour_frame(tickets)
    jobs = {
        "scan and filter": tickets.selectExpr("count(net_weight)"),
        "hourly_tally": hourly.hourly_tally(tickets),
        "heatmap": hourly.heatmap(tickets),
        "season_totals": daily.season_totals(tickets),
        "rolling_baseline": rolling.rolling_baseline(tickets),
        "range_comparison": hourstats.range_comparison(hourstats.battery(frame)),
        "training_records": training.training_records(tickets),
        "daily_scorecard": scorecard.daily_scorecard(tickets, "2025-01-01"),
    }
    for name, df in jobs.items():
        started = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - started
        print(f"{name:20s} {took:7.2f}s {millions / took:6.1f} million rows/s", flush=True)
    started = time.perf_counter()
    rolling.ticket_with_baseline(tickets).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - started
    print(f"{'ticket_with_baseline':20s} {took:7.2f}s {millions / took:6.1f} million rows/s")


if __name__ == "__main__":
    main()
