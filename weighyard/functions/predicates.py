"""Which tickets count."""

from weighyard import schema as S


def _text(name, ci):
    return f"lower(rtrim({name}))" if ci else name


def _any_of(values):
    return ", ".join(f"'{v}'" for v in values)


def printed_ticket(ci=False):
    """The weak predicate: the queue slip was printed."""
    return f"{_text('print_q', ci)} = '{S.PRINTED_QUEUE}'"


def valid_ticket(ci=False):
    """The full predicate.

    A ticket without a lane fails, since NOT IN of NULL is not true. `ci=True` compares
    like a database with case-insensitive, trailing-blank-insensitive text.
    """
    return (
        f"{printed_ticket(ci)} AND {_text('cane_type', ci)} IN ({_any_of((S.FRESH, S.BURNT))})"
        f" AND {_text('print_w', ci)} = '{S.PRINTED_WEIGHT}' AND net_weight > 0"
        f" AND {_text('lane_code', ci)} NOT IN ({_any_of(S.EXCLUDED_LANES)})"
    )


RULES = {"valid": valid_ticket, "printed": printed_ticket, "all": lambda ci=False: "true"}


def rule(predicate, ci=False):
    if predicate not in RULES:
        raise ValueError(f"unknown predicate {predicate!r}")
    return RULES[predicate](ci)


def date_range(start=None, end=None, column="report_date"):
    """Inclusive range on the raw date column, so that it reaches the scan."""
    parts = [f"{column} >= DATE'{start}'"] * (start is not None) + [f"{column} <= DATE'{end}'"] * (end is not None)
    return " AND ".join(parts) or "true"


def keep(tickets, predicate="valid", start=None, end=None, ci=False):
    """Tickets under the named predicate ('valid', 'printed' or 'all') and date range."""
    return tickets.where(f"({rule(predicate, ci)}) AND ({date_range(start, end)})")
