"""Ticket sources: files, JDBC and foreign column names."""

from datetime import timedelta

from pyspark.sql import functions as F

from weighyard import schema as S
from weighyard.functions.predicates import keep


def read_tickets(spark, path, start=None, end=None, predicate="all", fmt="parquet"):
    """Scan a ticket table; the range and the predicate are pushed to the scan."""
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(S.TICKET)
    if fmt == "csv":
        reader = reader.option("header", True)
    return keep(reader.load(path), predicate, start, end)


def jdbc_splits(start, end, days_per_split=1, hours_per_split=None,
                date_column="report_date", ts_column="ts"):
    """WHERE clauses that cut a JDBC read into independent, covering range scans.

    With `hours_per_split` every day is also cut by clock hour, so a day that holds a
    large part of all rows is still read by several tasks.
    """
    if hours_per_split is not None and not 1 <= hours_per_split <= 24:
        raise ValueError("hours_per_split must be between 1 and 24")
    clauses, day = [], start
    while day <= end:
        last = min(day + timedelta(days=days_per_split - 1), end)
        days = f"{date_column} BETWEEN '{day}' AND '{last}'"
        if hours_per_split is None:
            clauses.append(days)
        else:
            for hour in range(0, 24, hours_per_split):
                top = min(hour + hours_per_split, 24) - 1
                hours = f"DATEPART(hour, {ts_column}) BETWEEN {hour} AND {top}"
                # A ticket without a time still belongs to exactly one split.
                tail = f" OR {ts_column} IS NULL" if hour == 0 else ""
                clauses.append(f"{days} AND ({hours}{tail})")
        day = last + timedelta(days=1)
    return clauses


def read_tickets_jdbc(spark, url, table, start, end, properties=None, days_per_split=1,
                      hours_per_split=None, mapping=None):
    """Parallel JDBC scan of the inclusive date range, one task per split."""
    names = mapping or {}
    splits = jdbc_splits(start, end, days_per_split, hours_per_split,
                         date_column=names.get("report_date", "report_date"),
                         ts_column=names.get("ts", "ts"))
    raw = spark.read.jdbc(url=url, table=table, predicates=splits, properties=properties or {})
    return adapt(raw, mapping)


def find_date_column(columns):
    """The first column whose name speaks of a date or a report."""
    for name in columns:
        if "date" in name.lower() or "report" in name.lower():
            return name
    raise KeyError(f"no date column among {list(columns)}")


def adapt(df, mapping=None):
    """Bring a foreign table to the canonical ticket columns.

    `mapping` is canonical name -> source name. Source names are matched without regard
    to case; a missing `report_date` is taken from the first date-like column; other
    missing columns become NULL.
    """
    mapping = mapping or {}
    present = {name.lower(): name for name in df.columns}
    out = []
    for field in S.TICKET.fields:
        source = present.get(mapping.get(field.name, field.name).lower())
        if source is None and field.name in mapping:
            raise KeyError(f"column {mapping[field.name]!r} not among {df.columns}")
        if source is None and field.name == "report_date":
            source = find_date_column(df.columns)
        column = F.lit(None) if source is None else F.col(f"`{source}`")
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)


def ticket_extract(tickets, start=None, end=None, ordered=True):
    """All columns of the valid tickets in a range, by day, time and ticket.

    Training does not depend on the order and passes ordered=False to skip the sort.
    """
    chosen = keep(tickets, "valid", start, end)
    return chosen.orderBy("report_date", "ts", "ticket_id") if ordered else chosen
