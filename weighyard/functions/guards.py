"""Guarded arithmetic and cleaning of numeric values."""

from pyspark.sql import types as T

from weighyard.functions.layers import replace


def double(sql):
    return f"CAST({sql} AS DOUBLE)"


def ratio(numerator, denominator, default="0.0D"):
    """numerator / denominator, or `default` unless the denominator is > 0."""
    return (f"coalesce(IF({denominator} > 0, {double(numerator)} / {double(denominator)}, NULL), "
            f"{default})")


def percent(part, whole, default="0.0D"):
    """part / whole * 100, guarded like `ratio`."""
    return f"coalesce(IF({whole} > 0, {double(part)} / {double(whole)} * 100, NULL), {default})"


def percent_change(new, old):
    """(new - old) / old * 100, or 0 unless old > 0."""
    new, old = double(new), double(old)
    return f"coalesce(IF({old} > 0, ({new} - {old}) / {old} * 100, NULL), 0.0D)"


def correlation(x, y):
    """Pearson correlation as an aggregate; NULL where a side is constant.

    The built-in corr divides by zero there, which is an error in ANSI mode.
    """
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"


def clean_number(sql):
    """NULL, NaN and the infinities become 0."""
    value = double(sql)
    return (f"CASE WHEN {value} IS NULL OR isnan({value}) OR abs({value}) = double('Infinity') "
            f"THEN 0.0D ELSE {value} END")


def clean_text_number(sql):
    """Text to number; empty text, 'none', 'null' and anything unreadable become 0."""
    return clean_number(f"try_cast(trim({sql}) AS DOUBLE)")


def clean_numeric(df, columns=None):
    """Clean the given columns, text ones included (default: all numeric columns)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    chosen = columns or [n for n, t in fields.items() if isinstance(t, T.NumericType)]
    return replace(df, {
        name: clean_text_number(name) if isinstance(fields[name], T.StringType) else clean_number(name)
        for name in chosen
    })
