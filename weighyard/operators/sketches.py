"""Distinct counts that merge: a sketch per day, united over any range of days.

A sketch is a few kilobytes whatever the day's tickets, so a table of them answers any range without
going back to the tickets. The relative standard error is about 1.04 / sqrt(2 ** lg_config).
"""

from pyspark.sql import functions as F

from weighyard.functions.predicates import date_range, keep

LG_CONFIG = 12
#: Three standard errors of a sketch of this size.
TOLERANCE = 3 * 1.04 / 2 ** (LG_CONFIG / 2)


def truck_sketches(tickets, predicate="valid", start=None, end=None, column="truck_q"):
    """(report_date, sketch) of the distinct trucks of each day."""
    rows = keep(tickets, predicate, start, end).where("report_date IS NOT NULL")
    return rows.groupBy("report_date").agg(F.hll_sketch_agg(column, F.lit(LG_CONFIG)).alias("sketch"))


def distinct_range(sketches, start=None, end=None):
    """One row: days with tickets and the estimated number of distinct trucks of a range."""
    chosen = sketches.where(date_range(start, end))
    return chosen.agg(F.count(F.lit(1)).alias("days"),
                      F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("bigint").alias("trucks"))


def distinct_by(sketches, period="date_format(report_date, 'yyyy-MM')", name="month"):
    """The estimate for every period the days fall into."""
    return sketches.groupBy(F.expr(period).alias(name)).agg(
        F.count(F.lit(1)).alias("days"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("trucks"))


def distinct_exact(tickets, predicate="valid", start=None, end=None, period=None, name="month", column="truck_q"):
    """The exact count of a range or of every period; it shuffles every distinct truck."""
    rows = keep(tickets, predicate, start, end).where("report_date IS NOT NULL")
    outputs = (F.countDistinct("report_date").alias("days"), F.countDistinct(column).alias("trucks"))
    return rows.groupBy(F.expr(period).alias(name)).agg(*outputs) if period else rows.agg(*outputs)
