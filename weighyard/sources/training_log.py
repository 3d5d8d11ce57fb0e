"""The append-only log of training runs."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighyard.schema import TRAINING_LOG


def log_entry(trained_at, start, end, days_used, records_used, data_source, model_path):
    """One log row as columns over any frame."""
    def text(value):
        return F.lit(None if value is None else str(value)).cast("string")

    return F.struct(
        text(trained_at).alias("trained_at"),
        F.struct(text(start).alias("start"), text(end).alias("end")).alias("train_range"),
        F.lit(days_used).cast("long").alias("days_used"),
        F.lit(records_used).cast("long").alias("total_records_used"),
        text(data_source).alias("data_source"),
        text(model_path).alias("model_path"),
    )


def log_runs(runs, path):
    """Commit runs to the log: one line per `run_id`, which names its folder.

    A run that is repeated, also one that broke off before, replaces its own line and no other.
    """
    runs.repartition("run_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def append_training_log(spark, path, *entry, run_id=None):
    """Append one run. With a `run_id` repeating it leaves one line; without one every call adds a line."""
    row = spark.range(1).select(F.lit(run_id or uuid.uuid4().hex).alias("run_id"), log_entry(*entry).alias("e"))
    log_runs(row.select("run_id", "e.*"), path)


def read_training_log(spark, path):
    """The log's lines with their run_id."""
    return spark.read.schema(T.StructType([*TRAINING_LOG.fields, T.StructField("run_id", T.StringType())])).json(path)


def _valid(log):
    start, end = F.col("train_range.start"), F.col("train_range.end")
    return log.where((F.length(start) > 0) & (F.length(end) > 0))


def trained_ranges(log):
    """Ranges with both ends, by start."""
    return _valid(log).select(
        F.col("train_range.start").alias("start"), F.col("train_range.end").alias("end"), "trained_at",
    ).orderBy("start")


def trained_years(log):
    """Number of valid ranges and the distinct years they touch."""
    years = F.array(*[F.substring(f"train_range.{side}", 1, 4).cast("int") for side in ("start", "end")])
    return _valid(log).select("train_range", F.explode(years).alias("year")).agg(
        (F.count(F.lit(1)) / 2).cast("bigint").alias("count"),
        F.array_sort(F.collect_set("year")).alias("years"),
    )
