"""Text forms used in tables and exports."""


def month_key(day="report_date"):
    return f"date_format({day}, 'yyyy-MM')"


def day_key(day="report_date"):
    return f"date_format({day}, 'yyyy-MM-dd')"


def grouped_number(value, digits=2):
    """1,234.50"""
    return f"format_number({value}, {digits})"


def signed_percent(value, digits=1):
    """+4.2%"""
    return f"format_string('%+.{digits}f%%', CAST({value} AS DOUBLE))"


def number_in_text(text):
    """The number a text shows (grouping commas dropped), or NULL where it is no number."""
    return f"try_cast(regexp_replace({text}, ',', '') AS DOUBLE)"
