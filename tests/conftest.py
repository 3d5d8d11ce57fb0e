import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weighyard import schema as S  # noqa: E402
from weighyard.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests", master="local[4]", shuffle_partitions=4,
        extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
               "spark.sql.maxMetadataStringLength": "2000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def business_day(ts):
    return (ts + dt.timedelta(hours=6)).date()


def ticket(ts, net=10, line="A", cane="1", lane="1", print_q="5", print_w="y", truck="7", report_date=None, ticket_id=0):
    ts = dt.datetime.fromisoformat(ts) if isinstance(ts, str) else ts
    return (ticket_id, ts, report_date or business_day(ts), None if net is None else Decimal(str(net)),
            line, cane, print_q, print_w, lane, truck)


@pytest.fixture
def tickets(spark):
    def build(*rows):
        return spark.createDataFrame([ticket(**r) if isinstance(r, dict) else r for r in rows], S.TICKET)
    return build


DAY_TYPES = ("report_date date, tons double, avg_tons double, fresh_pct double, avg_fresh_pct double, "
             "has_baseline boolean, line_a_tons double, line_b_tons double, fresh_tons double, burnt_tons double, "
             "active_hours int, peak_tons double, has_trend boolean, tons_trend double, fresh_trend double")


@pytest.fixture
def day_rows(spark):
    """Day records from keyword dictionaries."""
    names = [part.split()[0] for part in DAY_TYPES.split(", ")]
    empty = dict.fromkeys(names, 0.0) | {
        "report_date": dt.date(2025, 1, 15), "has_baseline": True, "has_trend": False, "active_hours": 0}

    def build(*rows):
        filled = []
        for row in rows:
            full = empty | row
            filled.append(tuple(float(full[n]) if isinstance(empty[n], float) and full[n] is not None else full[n]
                                for n in names))
        return spark.createDataFrame(filled, DAY_TYPES)
    return build
