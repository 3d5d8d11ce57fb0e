"""Live tables that stay the size of their days: tallies, day totals, alerts and arrival counts.

Every table is partitioned by report_date and keyed within a day. A micro-batch merges its rows into
the partitions of the days it touched and replaces only those (dynamic partition overwrite), so the
number of files follows the days, not the batches, and a batch that is repeated after a
failure leaves the same table. A micro-batch reads the partitions it needs, never a whole table.
"""

from pyspark.sql import functions as F

from weighyard.functions.codes import explode_findings
from weighyard.functions.guards import percent
from weighyard.functions.layers import aggregates, named
from weighyard.functions.predicates import keep
from weighyard.operators.hourly import TALLY, slot_sums
from weighyard.operators.rolling import WEEK, WEEK_BEFORE, baseline_columns, trailing, trend_columns
from weighyard.operators.rules import base_alerts
from weighyard.plans.joins import settle
from weighyard.session import path_exists
from weighyard.streaming import live

DAY = "report_date"
#: How many days back a day's alerts look; a changed day touches as many days ahead.
REACH = WEEK_BEFORE[1]


def read_days(spark, path, schema, days=None):
    """A live table, or its partitions of the dates in `days` (a frame with report_date); empty before the first write."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(path)
    if days is None:
        return table
    # The dates of a batch are bounded by the calendar; as values they prune the partitions.
    dates = [row[0] for row in days.select(DAY).distinct().collect()]
    return table.where(F.col(DAY).isin(dates))


def replace_days(rows, path):
    """Put `rows` in place of the partitions of their days, one file per day."""
    rows.repartition(DAY).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def merge_days(changed, path, keys):
    """Merge changed rows into a live table by key; returns the rows of the touched days."""
    spark = changed.sparkSession
    old = read_days(spark, path, changed.schema, changed)
    kept = old.join(changed.select(*keys).distinct(), list(keys), "left_anti")
    merged = settle(kept.unionByName(changed))
    replace_days(merged, path)
    return merged


def _run(stream, write, checkpoint, trigger=None):
    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start())


def start_table(stream, path, checkpoint, keys, trigger=None):
    """Run an update-mode query into a live table with one row per key."""
    def write(batch, batch_id):
        changed = settle(batch.where(f"{DAY} IS NOT NULL"))
        if not changed.isEmpty():
            merge_days(changed, path, keys)
    return _run(stream, write, checkpoint, trigger)


# --- alerts ---------------------------------------------------------------------------------

def _shifted(days, first, last):
    """The dates from `first` to `last` days after each date."""
    return days.selectExpr(f"explode(sequence(date_add({DAY}, {first}), date_add({DAY}, {last}))) AS {DAY}").distinct()


def alerts_now(spark, day_path, schema, touched):
    """(days judged, alerts of today's state) for touched days and the days whose baseline they are part of."""
    judged = read_days(spark, day_path, schema, _shifted(touched, 0, REACH)).select(DAY)
    rows = read_days(spark, day_path, schema, _shifted(judged, -REACH, 0))
    facts = rows.selectExpr(DAY, "total_tons", "all_tons AS tons", "fresh_tons", "burnt_tons", "active_hours",
                            "all_count > 0 AS has_tickets")
    spans = trailing(facts, {"week": WEEK, "prior": WEEK_BEFORE}, data="has_tickets",
                     carry=("total_tons", "fresh_tons", "burnt_tons", "active_hours"))
    facts = spans.selectExpr(DAY, "total_tons", "fresh_tons", "burnt_tons", "active_hours",
                             *named(baseline_columns()), *named(trend_columns()))
    days = facts.join(F.broadcast(judged), DAY, "left_semi").selectExpr(DAY, *named({
        "tons": "CAST(total_tons AS DOUBLE)", "active_hours": "active_hours",
        "fresh_pct": percent("fresh_tons", "(fresh_tons + burnt_tons)"),
        "avg_tons": "avg_daily_tons", "avg_fresh_pct": "avg_fresh_percent",
        "has_trend": "has_trend_data", "tons_trend": "coalesce(tons_trend_percent, 0.0D)"}))
    return judged, explode_findings(base_alerts(days), "alerts")


ALERT_KEY = (DAY, "level", "code")
ALERT_TABLE = (f"{DAY} date, level string, code string, value double, state string, "
               "opened_batch bigint, closed_batch bigint")


def merge_alerts(spark, judged, found, path, batch_id):
    """Open what is found, close what is no longer found, on the judged days; other days stay."""
    old = read_days(spark, path, ALERT_TABLE, judged)
    now = found.select(*ALERT_KEY, F.col("value").alias("now_value"), F.lit(True).alias("found"))
    both = old.join(now, list(ALERT_KEY), "full_outer")
    opened = f"IF(state = 'open', opened_batch, {batch_id}L)"
    merged = settle(both.selectExpr(
        *ALERT_KEY, "IF(found, now_value, value) AS value", "IF(found, 'open', 'closed') AS state",
        f"IF(found, {opened}, opened_batch) AS opened_batch",
        f"CASE WHEN found THEN NULL WHEN state = 'open' THEN {batch_id}L ELSE closed_batch END AS closed_batch"))
    if not merged.isEmpty():
        replace_days(merged, path)


def start_alert_table(day_stream, path, checkpoint, trigger=None):
    """Keep <path>/days (running totals) and <path>/alerts (one row per day and code, open or closed).

    `day_stream` is `live.live_day(..., whole=True)`. Days of the past may be laid down in <path>/days
    beforehand by `write_day_table`. Each micro-batch judges the days it touched and the 14 days after each of
    them, from the partitions those need: an alert that no longer holds is closed, not repeated.
    """
    def write(batch, batch_id):
        spark = batch.sparkSession
        changed = settle(batch.where(f"{DAY} IS NOT NULL"))
        if changed.isEmpty():
            return
        merge_days(changed, f"{path}/days", (DAY,))
        judged, found = alerts_now(spark, f"{path}/days", changed.schema, changed)
        merge_alerts(spark, settle(judged), settle(found), f"{path}/alerts", batch_id)
    return _run(day_stream, write, checkpoint, trigger)


def open_alerts(spark, path):
    return read_days(spark, f"{path}/alerts", ALERT_TABLE).where("state = 'open'").select(*ALERT_KEY, "value")


def day_table(tickets, predicate="valid"):
    """The rows `live_day(whole=True)` would hold after all tickets, from a batch table."""
    return keep(tickets, predicate).where("ts IS NOT NULL").groupBy(
        F.expr(live.business_date("ts")).alias(DAY)).agg(*aggregates(live.DAY_TOTALS)).selectExpr(
        DAY, *live.DAY_TOTALS, *live.TOTALS)


def write_day_table(tickets, path, predicate="valid"):
    replace_days(day_table(tickets, predicate), f"{path}/days")


# --- tickets beyond the watermark -----------------------------------------------------------

ARRIVALS = f"{DAY} date, arrived bigint, last_batch bigint"


def start_arrivals(tickets, path, checkpoint, predicate="valid", trigger=None):
    """Count the tickets that came in per business day, however late; no watermark, no state."""
    def write(batch, batch_id):
        spark = batch.sparkSession
        counted = settle(keep(batch, predicate).where("ts IS NOT NULL").groupBy(
            F.expr(live.business_date("ts")).alias(DAY)).agg(F.count("net_weight").alias("n")))
        if counted.isEmpty():
            return
        old = read_days(spark, path, ARRIVALS, counted)
        # A repeated batch has been counted already where its number is the last one.
        merged = settle(counted.join(old, DAY, "left").selectExpr(
            DAY, f"coalesce(arrived, 0L) + IF(last_batch >= {batch_id}L, 0L, n) AS arrived",
            f"greatest(coalesce(last_batch, {batch_id}L), {batch_id}L) AS last_batch"))
        replace_days(merged, path)
    return _run(tickets, write, checkpoint, trigger)


def short_days(spark, tally_path, schema, arrivals_path):
    """Days of which the live tally has fewer tickets than came in."""
    tallied = read_days(spark, tally_path, schema).groupBy(DAY).agg(F.sum("all_count").alias("tallied"))
    return read_days(spark, arrivals_path, ARRIVALS).join(tallied, DAY, "left").where(
        "arrived > coalesce(tallied, 0)").select(DAY)


def retally_short_days(tickets, tally_path, schema, arrivals_path, predicate="valid"):
    """Tally the days that fell short anew from the stored tickets and put them in place; returns these days.

    A stream drops tickets that come after its watermark. Their days are read again by date, and
    only those; the next update of such a day by the stream makes it short again, and the next call mends it.
    """
    spark = tickets.sparkSession
    days = settle(short_days(spark, tally_path, schema, arrivals_path))
    if days.isEmpty():
        return days
    # A business day reaches from 18:00 of the day before; the stamped date of a ticket need not be its own.
    rows = keep(tickets, predicate).withColumn(DAY, F.expr(live.business_date("ts"))).join(
        F.broadcast(days), DAY, "left_semi")
    sums = slot_sums(rows).selectExpr(
        DAY, "slot", "a_count", "a_tons", "b_count", "b_tons", "fresh_tons", "burnt_tons", "all_count", "all_tons",
        "a_count + b_count AS total_count", "CAST(a_tons + b_tons AS DECIMAL(28,2)) AS total_tons")
    replace_days(settle(sums.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])), tally_path)
    return days


def tally_columns(table):
    """A live hour table in the columns of the tally."""
    return table.select(DAY, "slot", *TALLY)
