"""Live tallies and alerts.

A polling dashboard sees a late ticket at its next scan. Here the watermark delay says
how late a ticket may be; the default of a day covers every ticket of the business day.
"""

from pyspark.sql import functions as F

from weighyard import schema as S
from weighyard.functions.clock import business_date, slot_of
from weighyard.functions.codes import explode_findings
from weighyard.functions.guards import percent
from weighyard.functions.layers import aggregates
from weighyard.functions.predicates import keep
from weighyard.operators.hourly import IS_BURNT, IS_FRESH, ON_A, ON_B, count_where, tons_where
from weighyard.operators.rules import base_alerts

DELAY = "24 hours"


def read_ticket_stream(spark, path, files_per_trigger=None, glob=None, schema=None, fmt="parquet"):
    """Files of tickets as a stream."""
    reader = spark.readStream.schema(schema or S.TICKET).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "Zulu", "Universal", "+00:00")


def _event_time(tickets):
    """Wall-clock time as a time stamp, which watermarks and windows need.

    Windows start at multiples of their length in UTC, so the session must be on UTC for
    18:00 to be 18:00.
    """
    zone = tickets.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC for live tallies, not {zone}")
    return tickets.selectExpr("*", "CAST(ts AS TIMESTAMP) AS event_time")


TALLY = {
    "a_count": count_where(ON_A), "a_tons": tons_where(ON_A),
    "b_count": count_where(ON_B), "b_tons": tons_where(ON_B),
    "fresh_tons": tons_where(IS_FRESH), "burnt_tons": tons_where(IS_BURNT),
}
TOTALS = ("a_count + b_count AS total_count", "CAST(a_tons + b_tons AS DECIMAL(28,2)) AS total_tons")
STARTED = "CAST(window.start AS TIMESTAMP_NTZ)"
# All tickets, also those of other lines: what baselines and arrival counts are made of.
WHOLE = {"all_count": "count(net_weight)", "all_tons": tons_where()}
# At most 24 members, so the state of a day stays small.
ACTIVE = {"active_hours": f"size(collect_set(IF({ON_A} OR {ON_B}, hour(ts), NULL)))"}
DAY_TOTALS = {**TALLY, **WHOLE, **ACTIVE}


def live_hourly(tickets, delay=DELAY, predicate="valid", whole=False):
    """Running tally per hour, with `whole` of all tickets too; use it in update mode."""
    sums = {**TALLY, **(WHOLE if whole else {})}
    rows = keep(_event_time(tickets), predicate).withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", "1 hour")).agg(*aggregates(sums)).selectExpr(
        f"{business_date(STARTED)} AS report_date", f"{slot_of(STARTED)} AS slot", *sums, *TOTALS)


def live_day(tickets, delay=DELAY, predicate="valid", whole=False):
    """Running totals of the business day (18:00 to 18:00) and its active hours, with `whole` of all tickets too."""
    sums = DAY_TOTALS if whole else {**TALLY, **ACTIVE}
    rows = keep(_event_time(tickets), predicate).withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", "1 day", startTime="18 hours")).agg(
        *aggregates(sums)).selectExpr(f"{business_date(STARTED)} AS report_date", *sums, *TOTALS)


def running_alerts(day_totals, history):
    """Alerts on running totals; `history` has avg_tons, avg_fresh_pct and trend per day."""
    days = day_totals.selectExpr(
        "report_date", "CAST(total_tons AS DOUBLE) AS tons", "active_hours",
        f"{percent('fresh_tons', '(fresh_tons + burnt_tons)')} AS fresh_pct",
    ).join(history, "report_date", "left")
    return explode_findings(base_alerts(days), "alerts")


def _batch_writer(path, transform=None):
    """Write each micro-batch to its own folder; a repeated batch replaces itself."""
    def write(batch, batch_id):
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def start_updates(stream, path, checkpoint, transform=None, trigger=None):
    """Run an update-mode query into per-batch folders."""
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(_batch_writer(path, transform))
        .start()
    )


def start_alerts(day_stream, history, path, checkpoint, trigger=None):
    """Append the alerts of every micro-batch of running day totals."""
    return start_updates(day_stream, path, checkpoint, lambda b: running_alerts(b, history), trigger)


def latest_updates(spark, path, keys):
    """The last version of each key over all batches written by `start_updates`."""
    log = spark.read.parquet(path)
    others = [c for c in log.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*others), "batch_id").alias("_last")
    return log.groupBy(*keys).agg(newest).select(*keys, "_last.*")
