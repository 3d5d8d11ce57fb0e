"""Ticket views of general-purpose tables: an event log and an order-line history."""

from weighyard.functions.clock import business_date
from weighyard.functions.layers import named
from weighyard.schema import TICKET_COLUMNS


def load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_tickets(events):
    """One ticket per event, weighed at the event time."""
    ts = "CAST(ts AS TIMESTAMP_NTZ)"
    return events.selectExpr(*named({
        "ticket_id": "event_id", "ts": ts, "report_date": business_date(ts),
        "net_weight": "CAST(value AS DECIMAL(18,2))",
        "prod_line": "CASE WHEN event_type IN ('click', 'view') THEN 'A' "
                     "WHEN event_type IN ('purchase', 'signup') THEN 'B' END",
        "cane_type": "IF(user_id % 4 <> 0, '1', '2')",
        "print_q": "IF(event_type = 'error', '0', '5')",
        "print_w": "'y'",
        "lane_code": "CAST(user_id AS STRING)", "truck_q": "CAST(user_id AS STRING)",
    }))


def lineitem_tickets(lineitem, clock=False):
    """One ticket per order line on its ship date.

    Ship dates have no time of day. `clock=True` derives one from the keys, which gives
    a history of several years with hours; the report date then follows the clock.
    """
    ts = "CAST(l_shipdate AS TIMESTAMP_NTZ)"
    day = f"CAST({ts} AS DATE)"
    if clock:
        seconds = "(l_partkey % 24) * 3600 + (l_orderkey % 60) * 60 + l_linenumber"
        ts = f"({ts} + INTERVAL '1' SECOND * ({seconds}))"
        day = business_date(ts)
    return lineitem.selectExpr(*named({
        "ticket_id": "l_orderkey * 10 + l_linenumber", "ts": ts, "report_date": day,
        "net_weight": "CAST(l_quantity AS DECIMAL(18,2))",
        "prod_line": "CASE l_linestatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' END",
        "cane_type": "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE '3' END",
        "print_q": "'5'", "print_w": "'y'",
        "lane_code": "CAST(l_suppkey AS STRING)", "truck_q": "CAST(l_orderkey AS STRING)",
    }))


def from_events(spark, folder):
    return event_tickets(load(spark, folder, "events")).select(*TICKET_COLUMNS)


def from_lineitem(spark, folder, clock=False):
    return lineitem_tickets(load(spark, folder, "lineitem"), clock).select(*TICKET_COLUMNS)


def event_tickets_loose(events):
    """Event tickets as a database with a lax collation holds them: mixed case, trailing blanks.

    The text columns that decide whether a ticket counts carry the collation, so predicates on them
    stay plain equalities and compare as that database would.
    """
    blanks = "repeat(' ', CAST(event_id % 3 AS INT))"
    texts = {"print_q": f"concat(print_q, {blanks})", "cane_type": f"concat(cane_type, {blanks})",
             "print_w": f"concat(IF(event_id % 2 = 0, 'Y', 'y'), {blanks})", "lane_code": f"concat(lane_code, {blanks})"}
    loose = event_tickets(events).withColumnRenamed("ticket_id", "event_id").selectExpr(
        "event_id AS ticket_id", *[f"{text} AS {name}" for name, text in texts.items()],
        *[c for c in TICKET_COLUMNS if c not in (*texts, "ticket_id")])
    return collated(loose.select(*TICKET_COLUMNS))


#: Ignores case and trailing blanks, like the usual server collations.
LOOSE = "UTF8_LCASE_RTRIM"


def collated(tickets, columns=("print_q", "cane_type", "print_w", "lane_code"), collation=LOOSE):
    """Tickets whose deciding text columns compare under a collation; stored texts stay as they are."""
    return tickets.withColumns({c: tickets[c].cast(f"string collate {collation}") for c in columns})


def event_tickets_on_the_hour(events):
    """Event tickets of which every fifth was weighed at the full hour, for bins closed on both ends."""
    return event_tickets(events.selectExpr(
        "* EXCEPT (ts)", "IF(event_id % 5 = 0, date_trunc('HOUR', ts), ts) AS ts"))


def arrivals(tickets, late_every=20):
    """Event tickets with the number (0, 1, 2) of the delivery that brings them: thirds of the month by
    time, but every `late_every`-th ticket comes with the last delivery."""
    day = "dayofmonth(ts)"
    return tickets.selectExpr("*", (
        f"CASE WHEN ticket_id % {late_every} = 0 THEN 2 WHEN {day} <= 10 THEN 0 WHEN {day} <= 20 THEN 1 ELSE 2 END AS delivery"))
