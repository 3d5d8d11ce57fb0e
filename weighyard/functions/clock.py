"""Business-day arithmetic: 24 one-hour slots starting at 18:00 of the day before."""

from weighyard.functions.layers import add
from weighyard.schema import DAY_START_HOUR, SLOTS_PER_DAY

_SHIFT = SLOTS_PER_DAY - DAY_START_HOUR


def business_date(ts="ts"):
    return f"CAST({ts} + INTERVAL {_SHIFT} HOURS AS DATE)"


def slot_of(ts="ts"):
    return f"((hour({ts}) + {_SHIFT}) % {SLOTS_PER_DAY})"


def slot_label(slot="slot"):
    """'18:00-19:00' for slot 0."""
    begin = f"lpad(({slot} + {DAY_START_HOUR}) % {SLOTS_PER_DAY}, 2, '0')"
    end = f"lpad(({slot} + {DAY_START_HOUR + 1}) % {SLOTS_PER_DAY}, 2, '0')"
    return f"concat({begin}, ':00-', {end}, ':00')"


def slot_start(report_date, slot):
    """Wall-clock start of a slot."""
    midnight = f"CAST(date_sub({report_date}, 1) AS TIMESTAMP_NTZ)"
    return f"{midnight} + make_dt_interval(0, {slot} + {DAY_START_HOUR})"


def seconds_into_hour(ts="ts"):
    """Seconds since the full hour, with the fraction."""
    return f"(minute({ts}) * 60 + extract(SECOND FROM {ts}))"


def closed_places(ts="ts"):
    """The times a ticket is counted at when hours are closed on both ends."""
    return f"IF({seconds_into_hour(ts)} = 0, array({ts}, {ts} - INTERVAL 1 HOUR), array({ts}))"


def with_business_day(df):
    """Adds business date, slot, its label and its start to rows with `ts`."""
    return add(df, {
        "business_date": business_date(), "slot": slot_of(),
        "slot_label": slot_label(slot_of()),
        "slot_start": slot_start(business_date(), slot_of()),
    })
