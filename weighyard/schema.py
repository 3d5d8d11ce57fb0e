"""Canonical column layouts and the fixed values shared by the operators."""

from pyspark.sql import types as T

TONS = T.DecimalType(18, 2)

TICKET = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("report_date", T.DateType()),
    T.StructField("net_weight", TONS),
    T.StructField("prod_line", T.StringType()),
    T.StructField("cane_type", T.StringType()),
    T.StructField("print_q", T.StringType()),
    T.StructField("print_w", T.StringType()),
    T.StructField("lane_code", T.StringType()),
    T.StructField("truck_q", T.StringType()),
])

TICKET_COLUMNS = tuple(TICKET.fieldNames())

# They decide which tickets count, so they must stay as they are.
PRINTED_QUEUE = "5"
PRINTED_WEIGHT = "y"
LINE_A = "A"
LINE_B = "B"
FRESH = "1"
BURNT = "2"
EXCLUDED_LANES = ("10", "20", "30", "31", "40", "41", "50", "80", "81")

# A business day runs from 18:00 of the day before to 18:00.
DAY_START_HOUR = 18
SLOTS_PER_DAY = 24

# One row per training run.
TRAINING_LOG = T.StructType([
    T.StructField("trained_at", T.StringType()),
    T.StructField("train_range", T.StructType([
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
    ])),
    T.StructField("days_used", T.LongType()),
    T.StructField("total_records_used", T.LongType()),
    T.StructField("data_source", T.StringType()),
    T.StructField("model_path", T.StringType()),
])

# The per-day record that every scoring rule reads.
DAY_COLUMNS = (
    "report_date", "tons", "avg_tons", "fresh_pct", "avg_fresh_pct", "has_baseline",
    "line_a_tons", "line_b_tons", "fresh_tons", "burnt_tons",
    "active_hours", "peak_tons", "has_trend", "tons_trend", "fresh_trend",
)
