"""Every registered query next to its SQL on the smallest tables, and its plan."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in compare.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.sql(entry.oracle_sql()[name])
    left = compare.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert compare.compare(left, compare.rows_of(result.columns, result.fetchall())) == "same"
    assert left[1] or name == "stream_alerts"  # no alert on the smallest tables is fine
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|CartesianProduct", plan)
    # Ordered windows run within a day only.
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert all("[report_date#" in line for line in windows), windows


def test_entry(spark):
    card = entry.entry(spark)
    assert card.count() > 0 and "persona" in card.columns
