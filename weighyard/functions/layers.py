"""Adding and replacing groups of columns given as {name: SQL text}."""

from pyspark.sql import functions as F


def named(columns):
    """['sql AS name', ...]"""
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def add(df, columns):
    """New columns next to the old ones; later ones may use earlier ones of the same call."""
    return df.selectExpr("*", *named(columns))


def replace(df, columns):
    """The same columns in the same order, some with a new definition."""
    return df.selectExpr(*[f"{columns[c]} AS {c}" if c in columns else c for c in df.columns])


def aggregates(columns):
    """Column objects for groupBy(...).agg(...)."""
    return [F.expr(text) for text in named(columns)]
