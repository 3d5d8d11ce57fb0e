"""

Outputs are brought to plain types (bigint, double, text); values that depend on the order
of floating-point additions are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracles import all_statements
from oracles.rules import AS_OF
from weighyard import schema as S
from weighyard.functions.clock import with_business_day
from weighyard.functions.codes import explode_findings
from weighyard.functions.guards import clean_numeric
from weighyard.functions.predicates import keep
from weighyard.functions.text import grouped_number
from weighyard.operators import advice, daily, forecast, hourly, hourstats, personas, rolling, rules, sketches, training
from weighyard.plans import dashboard, models, reports, scorecard
from weighyard.session import scratch_path
from weighyard.sources import sinks, tables, training_log
from weighyard.sources.tickets import ticket_extract
from weighyard.streaming import live, serving

try:  # the corpus operators may be taken away; everything else works without them
    import corpus_pipeline
    from weighyard.llm import queries as corpus
except ImportError:
    corpus = corpus_pipeline = None

BANDS = dict(high=600, medium=400, low=200)
AS_OF_HOUR = 13
RANGE = {"start": "1996-02-20", "end": "1997-03-10"}


def plain(df: DataFrame, *rounded: str) -> DataFrame:
    """bigint, double and text only; `rounded` columns to six digits."""
    def shown(name, kind):
        if name in rounded:
            return f"round(CAST({name} AS DOUBLE), 6)"
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            return f"CAST({name} AS DOUBLE)"
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return f"CAST({name} AS BIGINT)"
        if isinstance(kind, T.TimestampNTZType):
            return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        if isinstance(kind, (T.DateType, T.BooleanType)):
            return f"CAST({name} AS STRING)"
        if isinstance(kind, T.ArrayType):
            return f"array_join(CAST({name} AS ARRAY<STRING>), ',')"
        return name

    return df.selectExpr(*[
        f"{shown(f'`{field.name}`' if field.name not in rounded else field.name, field.dataType)} AS `{field.name}`"
        for field in df.schema.fields])


# --- inputs ---------------------------------------------------------------------------

def events(spark, sf):
    return tables.from_events(spark, sf)


def lines(spark, sf):
    return tables.from_lineitem(spark, sf)


def clocked(spark, sf):
    return tables.from_lineitem(spark, sf, clock=True)


def loose(spark, sf):
    return tables.event_tickets_loose(tables.load(spark, sf, "events"))


def on_the_hour(spark, sf):
    return tables.event_tickets_on_the_hour(tables.load(spark, sf, "events"))


def daily_counts(tickets):
    return daily.daily_training_agg(tickets, "all")


def frame(spark, sf):
    return hourly.hour_frame(events(spark, sf))


def battery(spark, sf):
    return hourstats.battery(frame(spark, sf), **BANDS)


def records(spark, sf):
    return scorecard.day_records(hourly.hour_frame(clocked(spark, sf)))


def judged(spark, sf):
    """Day records with scores, persona, patterns and efficiency."""
    return rules.analysis_mode(scorecard.scored(records(spark, sf)), AS_OF)


def trained(spark, sf):
    return training.training_records(clocked(spark, sf))


def predicted(spark, sf):
    """Training records with predictions that follow from the data, to test the rules on."""
    return trained(spark, sf).withColumns({
        "predicted_tons": F.col("avg_tons") * 1.2,
        "predicted_fresh": F.col("avg_fresh_pct") + F.col("tons_trend"),
        "p_good": (F.col("quantity") + F.col("quality") + F.col("stability")) / F.lit(15.0),
    })


def on(source, operator, *rounded, columns=None, **arguments):
    """A query: operator(source(...)) in plain types."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = operator(source(spark, sf), **arguments)
        return plain(out.select(*columns) if columns else out, *rounded)
    return query


# --- queries that need more than one step ------------------------------------------------

def q_hourly_export(spark, sf):
    path = scratch_path(spark, "hourly-export")
    tally = hourly.hourly_tally(events(spark, sf))
    sinks.export_table(tally, path)
    return plain(spark.read.schema(tally.schema).option("header", True).csv(path).select(*tally.columns))


def q_season_totals_view(spark, sf):
    tickets = lines(spark, sf)
    return plain(daily.season_totals(tickets, daily.season_total(tickets)))


def q_clean_numeric(spark, sf):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    dirty = tables.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.when(tax == 0, float("nan")).when(tax == 0.08, float("inf")).when(tax != 0.01, tax).alias("tax"),
        F.when(discount == 0, "none").when(discount == 0.01, "").when(
            discount != 0.02, discount.cast("string")).alias("discount"),
    )
    return plain(clean_numeric(dirty, ["tax", "discount"]))


def q_sorted_tally(spark, sf):
    grid = hourly.hourly_tally(events(spark, sf)).select(
        "report_date", "slot", F.expr(grouped_number("total_tons")).alias("total_text"))
    return plain(hourly.sorted_table(grid, "total_text", descending=True))


def q_recommendations(spark, sf):
    rows = advice.recommendations(judged(spark, sf), AS_OF_HOUR).selectExpr(
        "report_date", "inline_outer(recommendations)").where("category IS NOT NULL")
    return plain(rows.select(
        "report_date", "priority", "category", "detail", "next_cycle",
        F.col("actions")[0].alias("first_action"), F.size("actions").alias("action_count")))


def advice_at(hour):
    lists = ["practical", "actionable", "learning", "contextual", "proactive", "adaptive"]
    return on(judged, advice.advice, as_of_hour=hour, columns=["report_date", *lists])


def long_findings(operator, column):
    def query(spark, sf):
        return plain(explode_findings(operator(judged(spark, sf)), column), "value")
    return query


def scorecard_of(source):
    def query(spark, sf):
        card = scorecard.daily_scorecard(source(spark, sf), AS_OF, AS_OF_HOUR)
        return plain(scorecard.flat_scorecard(card), "anomaly_score", "overall_score")
    return query


def q_analysis_report(spark, sf):
    path = scratch_path(spark, "analysis-report")
    report = reports.analysis_report(scorecard.daily_scorecard(clocked(spark, sf), AS_OF, AS_OF_HOUR))
    sinks.export_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return plain(back.select(
        "report_date", "summary.total_tons", F.col("summary.total_trucks").alias("trucks"),
        F.col("summary.fresh_percentage").alias("fresh_pct"), F.col("analysis.status").alias("headline"),
        "analysis.score", "efficiency_metrics.volume_eff", "operational_insights",
        "predictions.projected_tons"), "score")


def q_efficiency_report(spark, sf):
    path = scratch_path(spark, "efficiency-report")
    report = reports.efficiency_report(frame(spark, sf), **BANDS)
    sinks.export_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    summary, detail = "executive_summary", "detailed_analysis"
    return plain(back.select(
        "report_date", F.col(f"{summary}.total_tons").alias("tons"), F.col(f"{summary}.total_trucks").alias("trucks"),
        f"{summary}.active_hours", f"{summary}.efficiency_ratio",
        F.col(f"{summary}.overall_performance_index").alias("overall_index"),
        F.col(f"{summary}.performance_level").alias("level"),
        f"{detail}.trend.direction", f"{detail}.trend.slope", f"{detail}.variability.stability",
        f"{detail}.correlation.balance", f"{detail}.peaks.peak_slots",
        F.size("hourly_breakdown").alias("breakdown_rows")), "overall_index", "slope")


def yearly_log(spark, sf):
    """A training log with one run per year of the history, written and read back."""
    path = scratch_path(spark, "training-log")
    first, last = F.min("report_date"), F.max("report_date")
    runs = keep(lines(spark, sf)).groupBy(F.year("report_date").alias("year")).agg(
        F.date_format(last, "yyyy-MM-dd 00:00:00").alias("trained_at"),
        F.struct(first.cast("string").alias("start"), last.cast("string").alias("end")).alias("train_range"),
        F.countDistinct("report_date").alias("days_used"), F.count(F.lit(1)).alias("total_records_used"))
    runs.drop("year").write.json(path)
    return training_log.read_training_log(spark, path)


def q_model_predictions(spark, sf):
    """Fit on the records, save, load, predict. Forests are not comparable in SQL."""
    days = trained(spark, sf)
    folder = scratch_path(spark, "models")
    models.save_models(models.fit_models(training.training_table(days)), folder)
    scored = models.predict(models.load_models(folder), days)
    clamped = forecast.clamp_prediction(forecast.compare_with_prediction(scored))
    return plain(clamped.select(
        "report_date", "tons", "predicted_tons", "predicted_fresh", "p_good", "clamped_tons",
        "tons_outlook", "fresh_outlook", "model_findings"))


def q_model_trend_outlook(spark, sf):
    days = trained(spark, sf)
    fitted = models.fit_models(training.training_table(days, leak_free=True))
    ahead = forecast.trend_outlook(models.predict_outlook(fitted, days))
    return plain(ahead.select("report_date", "outlook_tons_pct", "outlook_fresh_pp", "outlook", "outlook_confidence"))


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return tables.event_tickets(live.read_ticket_stream(spark, sf, glob="events.parquet", schema=schema))


def streamed(build, keys):
    """Run the stream over the files that are there and read the last state of each key."""
    def query(spark, sf):
        path = scratch_path(spark, "stream")
        live.start_updates(build(event_stream(spark, sf)), f"{path}/out", f"{path}/state").awaitTermination()
        return plain(live.latest_updates(spark, f"{path}/out", keys))
    return query


def q_stream_alerts(spark, sf):
    path = scratch_path(spark, "alerts")
    history = rolling.baseline_7d(events(spark, sf), idle_days=True).join(
        rolling.trend_7v7(events(spark, sf), idle_days=True), "report_date").select(
        "report_date", F.col("avg_daily_tons").alias("avg_tons"),
        F.col("avg_fresh_percent").alias("avg_fresh_pct"), F.col("has_trend_data").alias("has_trend"),
        F.col("tons_trend_percent").alias("tons_trend"))
    live.start_alerts(live.live_day(event_stream(spark, sf)), history, f"{path}/out", f"{path}/state").awaitTermination()
    return plain(spark.read.parquet(f"{path}/out").drop("batch_id"), "value")


def delivered(spark, sf, split):
    """Event tickets delivered to a folder in three parts; after each part every query in `runs` is run once."""
    path = scratch_path(spark, "deliveries")
    tickets = split(events(spark, sf))
    kept = [c for c in tickets.columns if c != "delivery"]

    def deliver(*runs):
        for part in range(3):
            tickets.where(f"delivery = {part}").select(*kept).write.mode("append").parquet(f"{path}/tickets")
            for run in runs:
                run(live.read_ticket_stream(spark, f"{path}/tickets")).awaitTermination()
        return path
    return deliver


def thirds(tickets):
    return tickets.selectExpr("*", "CAST(crc32(CAST(ticket_id AS STRING)) % 3 AS INT) AS delivery")


def q_stream_alert_table(spark, sf):
    """Three deliveries that each fill all days; alerts of the first ones are withdrawn by the last."""
    deliver, out = delivered(spark, sf, thirds), scratch_path(spark, "alert-table")
    deliver(lambda tickets: serving.start_alert_table(
        live.live_day(tickets, "60 days", whole=True), out, f"{out}/state"))
    return plain(serving.open_alerts(spark, out), "value")


def q_stream_hourly_late(spark, sf):
    """Three deliveries with tickets beyond the watermark; the days they belong to are tallied anew."""
    deliver, out = delivered(spark, sf, tables.arrivals), scratch_path(spark, "hour-table")
    schema = live.live_hourly(live.read_ticket_stream(spark, sf, schema=S.TICKET), whole=True).schema
    path = deliver(
        lambda tickets: serving.start_table(live.live_hourly(tickets, whole=True), f"{out}/hours", f"{out}/s1", ("report_date", "slot")),
        lambda tickets: serving.start_arrivals(tickets, f"{out}/arrivals", f"{out}/s2"))
    serving.retally_short_days(spark.read.parquet(f"{path}/tickets"), f"{out}/hours", schema, f"{out}/arrivals")
    return plain(serving.tally_columns(serving.read_days(spark, f"{out}/hours", schema)))


def q_distinct_trucks(spark, sf):
    """Distinct trucks per month from day sketches, next to the exact count; `near` tells whether they agree."""
    tickets = lines(spark, sf)
    near = sketches.distinct_by(sketches.truck_sketches(tickets)).withColumnRenamed("trucks", "estimate").drop("days")
    exact = sketches.distinct_exact(tickets, period="date_format(report_date, 'yyyy-MM')")
    return plain(exact.join(near, "month").selectExpr(
        "month", "days", "trucks", f"abs(estimate - trucks) <= greatest(1, {sketches.TOLERANCE} * trucks) AS near"))


def boards(build):
    def query(spark, sf):
        return plain(build(dashboard.dashboard(events(spark, sf), AS_OF, AS_OF_HOUR)), "overall_score")
    return query


def q_train_log(spark, sf):
    """One run per year of the history, committed twice: every run leaves one line."""
    path = scratch_path(spark, "committed-log")
    first, last = F.min("report_date"), F.max("report_date")
    runs = keep(lines(spark, sf)).groupBy(F.year("report_date").cast("string").alias("run_id")).agg(
        F.date_format(last, "yyyy-MM-dd 00:00:00").alias("trained_at"),
        F.struct(first.cast("string").alias("start"), last.cast("string").alias("end")).alias("train_range"),
        F.countDistinct("report_date").alias("days_used"), F.count(F.lit(1)).alias("total_records_used"))
    training_log.log_runs(runs, path)
    training_log.log_runs(runs, path)
    training_log.append_training_log(spark, path, "1990-01-01 00:00:00", "1989-01-01", "1989-12-31", 0, 0, "none", "", run_id="0")
    return plain(training_log.read_training_log(spark, path).selectExpr(
        "CAST(run_id AS STRING) AS run_id", "trained_at", "train_range.start AS first_day", "train_range.end AS last_day",
        "days_used", "total_records_used AS tickets"))


def trained_models(spark, sf):
    """A committed training job over the whole history: (its records, its models, the models read back)."""
    folder = scratch_path(spark, "trained")
    tickets = clocked(spark, sf)
    fitted = models.train_job(tickets, "1990-01-01", "2010-12-31", folder, trained_at="2010-12-31 00:00:00")
    return training.training_records(tickets, "1990-01-01", "2010-12-31"), fitted, models.committed_models(spark, folder)


def q_scaler_stats(spark, sf):
    return plain(models.scaler_stats(trained_models(spark, sf)[2], spark), "mean", "std")


def q_model_facts(spark, sf):
    days, fitted, reloaded = trained_models(spark, sf)
    return plain(models.model_facts(fitted, days, reloaded).drop("model_error"), "label_mean", "mean_error", "label_min", "label_max")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the daily scorecard of every day, straight from the tickets."""
    return scorecard_of(events)(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    index = ("efficiency_score", "consistency_score", "productivity_score", "balance_score", "overall_index")
    return {
        # scans, filters, sources, sinks
        "ticket_scan": on(events, lambda t: t),
        "ticket_extract": on(lines, ticket_extract),
        "valid_tickets": on(events, keep),
        "range_filter": on(lines, daily.range_filter, start="1996-01-01", end="2000-12-31"),
        "business_day": on(events, with_business_day,
                           columns=["ticket_id", "business_date", "slot", "slot_label", "slot_start"]),
        "clean_numeric": q_clean_numeric,
        "hourly_export": q_hourly_export,
        "analysis_report": q_analysis_report,
        "efficiency_report": q_efficiency_report,
        "trained_ranges": on(yearly_log, training_log.trained_ranges),
        "trained_years": on(yearly_log, training_log.trained_years),
        # hour slots
        "hourly_tally": on(events, hourly.hourly_tally),
        "hourly_tally_second": on(events, hourly.hourly_tally, closed="second"),
        "hourly_tally_closed": on(lines, hourly.queue_tally),
        "hourly_with_total": on(events, lambda t: hourly.with_day_total(hourly.hourly_tally(t))),
        "hourly_rollup": on(events, hourly.hourly_rollup),
        "hourly_closed_mixed": on(on_the_hour, hourly.queue_tally),
        "hourly_both_mixed": on(on_the_hour, hourly.hourly_tally, closed="both"),
        "valid_tickets_ci": on(loose, lambda t: daily_counts(keep(t))),
        "hour_efficiency": on(events, lambda t: hourly.hour_efficiency(hourly.hourly_tally(t), 600, 400),
                              columns=["report_date", "slot", "total_tons", "efficiency"]),
        "sorted_tally": q_sorted_tally,
        "heatmap": on(events, hourly.heatmap),
        "cumulative": on(frame, hourstats.cumulative),
        "moving_avg": on(frame, hourstats.moving_avg),
        "day_averages": on(frame, daily.day_averages),
        "exec_summary": on(frame, daily.exec_summary),
        "next_hour_forecast": on(frame, forecast.next_hour_forecast, "std_tons", "lower", "upper"),
        # statistics over the hours of a day
        "hourly_metrics": on(battery, hourstats.hourly_metrics),
        "hourly_trend": on(battery, hourstats.hourly_trend, "slope", "intercept", "r", "p_value", "change_pct"),
        "hourly_variability": on(battery, hourstats.hourly_variability,
                                 "std_pop", "var_pop", "cv_pct", "q25", "q50", "q75", "iqr"),
        "hourly_outliers": on(battery, hourstats.hourly_outliers),
        "peak_periods": on(battery, hourstats.peak_periods, "threshold"),
        "peak_runs": on(battery, hourstats.peak_runs),
        "hourly_correlation": on(battery, hourstats.hourly_correlation, "corr"),
        "performance_index_hourly": on(battery, hourstats.performance_index_hourly, *index),
        "hourly_insights": on(battery, hourstats.hourly_insights, "value"),
        "hourly_recommendations": on(battery, hourstats.hourly_recommendations, "value"),
        "range_comparison": on(battery, hourstats.range_comparison,
                               "avg_index", "avg_efficiency_ratio", "best_index", "worst_index"),
        "best_worst_day": on(battery, hourstats.best_worst_day, "overall_index"),
        # daily, monthly, season
        "season_totals": on(lines, daily.season_totals),
        "season_totals_view": q_season_totals_view,
        "daily_by_line": on(lines, daily.daily_by_line),
        "daily_weight": on(lines, daily.daily_weight),
        "daily_weight_summary": on(lines, lambda t: daily.daily_weight_summary(daily.daily_weight(t))),
        "monthly": on(lines, daily.monthly),
        "season_trend": on(lines, daily.season_trend, as_of="1995-09-15"),
        "ticket_stats": on(lines, daily.ticket_stats, "std_tons", as_of="1995-06-30"),
        "fresh_trend": on(lines, daily.fresh_trend, as_of="1995-06-30"),
        "share_panel": on(lines, daily.share_panel),
        "daily_training_agg": on(lines, daily.daily_training_agg),
        # trailing windows
        "baseline_7d": on(lines, rolling.baseline_7d),
        "trend_7v7": on(lines, rolling.trend_7v7),
        "performance_index": on(frame, rolling.performance_index),
        "rolling_baseline": on(lines, rolling.rolling_baseline),
        "rolling_trend": on(lines, rolling.rolling_trend),
        "ticket_with_baseline": on(lines, rolling.ticket_with_baseline),
        "week_compare": on(lines, rolling.week_compare),
        "week_compare_daily": on(lines, rolling.week_compare_daily),
        # ranges: the scan reads what the answers need
        "baseline_7d_range": on(lines, rolling.baseline_7d, **RANGE),
        "trend_7v7_range": on(lines, rolling.trend_7v7, **RANGE),
        "rolling_baseline_range": on(lines, rolling.rolling_baseline, **RANGE),
        "rolling_trend_range": on(lines, rolling.rolling_trend, **RANGE),
        "week_compare_range": on(lines, rolling.week_compare, **RANGE),
        "week_compare_day": on(lines, rolling.week_compare_daily, base_date=RANGE["end"]),
        "distinct_trucks": q_distinct_trucks,
        # rules over the day records
        "day_scores": on(judged, lambda d: d, columns=["report_date", "quantity", "quality", "stability"]),
        "persona": on(judged, lambda d: d, columns=["report_date", "trend_score", "persona"]),
        "persona_profile": on(judged, personas.persona_profile, columns=[
            "report_date", "persona", "tone", "priority", "risk_level", "response_time", "insights"]),
        "calendar_context": on(judged, lambda d: d, columns=["report_date", "holiday_context", "closed", "in_season"]),
        "day_status": on(judged, lambda d: d, columns=["report_date", "status"]),
        "analysis_mode": on(judged, lambda d: d, columns=["report_date", "mode"]),
        "flow_pattern": on(judged, lambda d: d, columns=["report_date", "flow_pattern"]),
        "patterns": on(judged, lambda d: d, "anomaly_score", columns=[
            "report_date", "season", "week_part", "hourly_pattern", "quality_pattern", "anomaly_score", "signals"]),
        "anomalies": long_findings(rules.anomalies, "anomalies"),
        "efficiency_metrics": on(judged, lambda d: d, columns=[
            "report_date", "volume_eff", "hourly_eff", "quality_eff", "peak_ratio", "volume_status",
            "hourly_status", "quality_status", "stability_status", "trend_direction", "quality_trend"]),
        "alerts": long_findings(rules.alerts, "alerts"),
        "insights": on(judged, rules.insights, columns=["report_date", "insights"]),
        "benchmarks": on(judged, rules.benchmarks, columns=[
            "report_date", "daily_target", "daily_progress", "remaining_target", "hourly_target", "hourly_rate",
            "hourly_progress", "quality_target", "quality_gap", "trend_target"]),
        "day_projection": on(judged, rules.day_projection, columns=["report_date", "projected_tons", "warnings"]),
        "time_context": on(judged, rules.time_context, as_of_hour=AS_OF_HOUR, columns=[
            "report_date", "day_part", "urgency", "weekday_name", "is_weekend", "holiday_season"]),
        "overall_score": on(judged, rules.overall_score, "overall_score", columns=["report_date", "overall_score"]),
        "recommendations": q_recommendations,
        "advice_morning": advice_at(8),
        "advice_afternoon": advice_at(AS_OF_HOUR),
        "advice_evening": advice_at(19),
        "daily_scorecard": scorecard_of(events),
        "daily_scorecard_history": scorecard_of(clocked),
        "dashboard_hours": boards(dashboard.dashboard_hours),
        "dashboard_days": boards(dashboard.dashboard_days),
        # models
        "train_log": q_train_log,
        "scaler_stats": q_scaler_stats,
        "model_facts": q_model_facts,
        "training_records": on(trained, lambda d: d),
        "ml_features": on(trained, training.training_table),
        "ml_clamp": on(predicted, forecast.clamp_prediction, columns=[
            "report_date", "tons", "predicted_tons", "clamped_tons", "clamped_fresh", "adjusted",
            "tons_change_pct", "fresh_change", "tons_outlook", "fresh_outlook", "confidence"]),
        "model_compare": on(predicted, forecast.compare_with_prediction,
                            columns=["report_date", "model_findings", "model_actions"]),
        "model_outlook": on(predicted, forecast.trend_outlook, columns=[
            "report_date", "outlook_tons_pct", "outlook_fresh_pp", "outlook", "outlook_confidence"]),
        "model_predictions": q_model_predictions,
        "model_trend_outlook": q_model_trend_outlook,
        # streams
        "stream_hourly_tally": streamed(live.live_hourly, ["report_date", "slot"]),
        "stream_day_total": streamed(live.live_day, ["report_date"]),
        "stream_alerts": q_stream_alerts,
        "stream_alert_table": q_stream_alert_table,
        "stream_hourly_late": q_stream_hourly_late,
        **corpus_queries(),
    }


def corpus_queries():
    return {} if corpus is None else corpus.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if corpus is None:
        return all_statements()
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return all_statements() | corpus.oracle_sql() | own
