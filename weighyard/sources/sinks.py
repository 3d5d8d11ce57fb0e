"""Writing tallies, reports and tickets."""

from pyspark.sql import functions as F


def write_tickets(tickets, path, mode="overwrite"):
    """Parquet partitioned by business day.

    The rebalance hint lets adaptive execution split a day that holds a large part of the
    rows over several files instead of sending it to one task.
    """
    placed = tickets.hint("rebalance", "report_date")
    placed.write.mode(mode).partitionBy("report_date").parquet(path)


def export_table(df, path, fmt="csv", mode="overwrite", partition_by="report_date"):
    """A table as CSV with header (or parquet/json), one folder per day."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def export_report(report, path, mode="overwrite"):
    """Report structs as JSON lines."""
    report.write.mode(mode).json(path)


def report_text(report):
    """The report structs as one JSON text per day."""
    return report.select("report_date", F.to_json(F.struct("*")).alias("report"))
